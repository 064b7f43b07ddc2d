import re

from driftloom.llm import decontamination

from .support import ODD, ascii_lower, rows, table


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def brute(docs, items):
    out = []
    lists = [(str(i), words(t)) for i, t in items]
    for d, t, *_ in docs:
        w, hit, met = words(t), set(), set()
        for i, item in lists:
            k = min(10, len(item))
            windows = {tuple(item[j : j + k]) for j in range(len(item) - k + 1)} if item else set()
            for j in range(len(w) - k + 1) if item else ():
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    met.add(i)
        out.append((str(d), len(w), len(hit), sorted(met)))
    return sorted(out)


def counted(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.hits(table(spark, docs, clashes=False), bench, **options)
    found = found.withColumn("hit", decontamination._covered(found["spans"]))
    return sorted((str(r["doc_id"]), r["n_words"], r["hit"], list(r["item_ids"])) for r in rows(found))


LONG = " ".join(f"item{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Alpha beta, gamma delta! epsilon zeta eta theta iota kappa lambda mu"), (3, None), (4, ""), (5, "just three words"), (6, "six words make this item short"), (7, LONG), (8, "single"), (9, "the the the the the the the the the the the"), (10, "Ünï çødé wörds zählen auch als wörter mit ä ö ü")]
TEXTS = [
    f"before {LONG} after", "x " + " ".join(f"item{i}" for i in range(5, 15)) + " y", " ".join(f"item{i}" for i in range(9)) + " cut", "alpha-beta gamma.delta epsilon zeta eta theta iota kappa", "here are just three words twice just three words", "a single word and six words make this item short",
    "the " * 30, "ünï çødé wörds zählen auch als wörter mit ä ö ü", "Ünï çødé wörds zählen auch als wörter mit ä ö ü", f"{LONG} {LONG}", "item1 item2 item3 item5 item6 item7 item8 item9 item10 item11 item12",
]


def test_windows_match_brute_force(spark):
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + ODD
    wanted = brute(docs, ITEMS)
    assert counted(spark, docs, ITEMS) == wanted
    assert counted(spark, docs, ITEMS, block=200) == wanted  # several blocks of the benchmark


def test_every_cut_of_a_shared_span_is_found(spark):
    docs = [(i, f"start{i} " + " ".join(f"item{j}" for j in range(i, i + 10)) + f" end{i}", "en", "s", 1) for i in range(31)]
    assert [r[2] for r in counted(spark, docs, [(1, LONG)])] == [10] * 31


def test_empty_tables(spark):
    assert counted(spark, [], ITEMS) == []
    assert counted(spark, ODD, []) == brute(ODD, [])


def test_columns_of_the_documents_are_carried(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = table(spark, ODD).drop("spans")
    found = decontamination.hits(docs, bench)
    assert found.columns == [c for c in docs.columns if c != "text"] + ["n_words", "spans", "item_ids"]
    assert {r["key"] for r in rows(found)} == {"own key"}
