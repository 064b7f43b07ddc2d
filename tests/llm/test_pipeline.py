import corpus_pipeline
from driftloom.llm import simhash
from driftloom.llm.common import row_key

from . import test_decontamination as leaks
from . import test_quality_rules as quality
from . import test_simhash as copies
from .support import ODD, rows, table

PROSE = [t.replace("river", f"river{i}").replace("water", " ".join(f"w{i}x{j}" for j in range(12))) for i, t in enumerate(quality.PROSE)]
LEAK = " ".join(f"item{i}" for i in range(40))
DATA = [(i, t, "en", "s", len(t)) for i, t in enumerate(PROSE)] + [(200, PROSE[3], "en", "s", 1), (201, PROSE[4] + " " + LEAK, "en", "s", 1), (202, PROSE[5] + " mail a.b@mail.example.com", "en", "s", 1)] + [(300 + i, t * 2, "en", "s", 1) for i, t in enumerate(quality.JUNK)] + ODD
ITEMS = [(1, LEAK)]


def test_stages_match_brute_force(spark, tmp_path):
    docs = table(spark, DATA, clashes=False)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "packing"]
    now = stage["quality_rules"](spark, docs, str(tmp_path))
    left = rows(now)
    assert now.columns == docs.columns and {r["doc_id"] for r in left} >= set(range(len(PROSE))) | {200, 201, 202} and not {r["doc_id"] for r in left} & {300, 301, 302, -3}
    unique = stage["near_duplicates"](spark, now, str(tmp_path))
    fps = [copies.fingerprint(r["text"]) for r in left]
    reach = copies.reach([r["doc_id"] for r in left], fps)
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in rows(unique)) == sorted(set(reach))
    clean = stage["decontamination"](spark, unique, str(tmp_path))
    hit = {d for d, _, n, _ in leaks.brute([(r["doc_id"], r["text"]) for r in rows(unique)], ITEMS) if n}
    assert clean.columns == docs.columns and {str(r["doc_id"]) for r in rows(clean)} == {str(r["doc_id"]) for r in rows(unique)} - hit and hit
    private = stage["personal_data"](spark, clean, str(tmp_path))
    texts = {r["doc_id"]: r for r in rows(private)}
    assert private.columns == docs.columns and len(texts) == clean.count() and "@" not in texts.get(202, texts[min(texts)])["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    packed = rows(stage["packing"](spark, private, str(tmp_path)))
    assert {r["doc_id"] for r in packed} == set(texts)


def test_run_over_a_folder(spark, tmp_path):
    table(spark, DATA, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20


def test_empty_documents(spark, tmp_path):
    docs = table(spark, [], clashes=False)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
    assert rows(docs) == []


def test_near_duplicates_are_simhash_groups_with_further_links(spark, tmp_path):
    line, plain = "one line that is found very often " * 20, [f"term{i}" for i in range(200)]
    texts = [line + " ".join(f"{c}{i}" for i in range(20)) for c in "ab"] + [" ".join([*plain[:50], w, *plain[51:]]) for w in ("term50", "changed")] + ["some other text that nobody copied"]
    fps = [copies.fingerprint(t) for t in texts]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4
    near = lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4
    assert (near(0, 1), alike(0, 1), near(2, 3), alike(2, 3)) == (True, False, False, True)  # the first pair by SimHash alone, the second not by it
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], clashes=False)
    kept = {r["doc_id"] for r in rows(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path)))}
    assert kept == {0, 2, 4}


def test_further_links_join_the_groups_of_fingerprints(spark):
    data = [(i, " ".join(f"t{i}x{j}" for j in range(12)), "en", "s", 1) for i in range(5)] + [(9, " ".join(f"t3x{j}" for j in range(12)), "en", "s", 1)] * 2
    docs = table(spark, data, clashes=False)
    keys = {r["doc_id"]: r["key"] for r in rows(docs.select("doc_id", row_key().alias("key")))}
    also = spark.createDataFrame([(keys[i], root) for i, root in ((0, 7), (1, 7), (1, 8), (9, 8), (2, 5))], "key struct<a:long,b:long>, root long")
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_duplicates(docs, also=also))}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 9: 0}
    assert sorted(r["doc_id"] for r in rows(simhash.keep_one(docs, also=also))) == [0, 2, 4]
