"""driftloom: declarative data preparation and analytics as lazy Spark plans."""
