"""Operator 6: benchmark decontamination by winnowing, in DataFrame functions only.

Every k-gram of words has a hash; in each run of w k-grams in a row the smallest is kept (k + w - 1 words are one
benchmark window). A window that a document and an item share keeps the same k-gram on both sides, so joining the kept
hashes meets every shared window. A hit is then extended: the windows around the met k-gram are compared word by word,
so hash collisions never count. Items shorter than a window are one window of their own; their first words' hash is
looked up among all k-grams of the documents.

Documents stream past the benchmark, which is broadcast in blocks of at most ``BLOCK`` bytes of its words; a benchmark
of any size takes one pass for each block. Equal items are one class, so a passage that many items repeat is joined
once. What leaves the pass is one narrow row per document (a mark that every document matches) and one per verified
hit; document texts are not shuffled.

Defined results: a null or blank text has no words and isn't contaminated; items without words are never met; rows of
documents that repeat (or share, or lack a doc_id) are counted apart; an empty benchmark leaves every document clean;
an empty documents table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEYS_SENT, cut, prepare, spread, table

#: Words of a window, of a hashed k-gram, and k-grams in a row of which the smallest is kept.
WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Bytes of benchmark words that are broadcast at once.
BLOCK = 32 << 20
#: Bits of a position beside the hash in one long: an array column can't have 2 ** 28 entries.
_AT = 28
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = -1


def ascii_lower(text: Column) -> Column:
    """A-Z only; texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _grams(hashes: Column, k: int, salt: int = 0) -> Column:
    """Packed (hash of k words, position) for each position where k words begin."""
    starts = F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(F.array().cast("array<int>"))
    hash_at = lambda i: F.xxhash64(F.lit(salt), *[F.get(hashes, i + j) for j in range(k)])
    return F.transform(starts, lambda i: hash_at(i).bitwiseAND(F.lit(-(1 << _AT))).bitwiseOR(i.cast("long")))


def _winnowed(grams: Column, w: int) -> Column:
    """The smallest of each w grams in a row, each once."""
    starts = F.when(F.size(grams) >= w, F.sequence(F.lit(0), F.size(grams) - w)).otherwise(F.array().cast("array<int>"))
    least = (lambda i: F.least(*[F.get(grams, i + j) for j in range(w)])) if w > 1 else lambda i: F.get(grams, i)
    return F.array_distinct(F.transform(starts, least))


def _kept(rows: DataFrame, short: list[int]) -> DataFrame:
    """rows (with ``words``) and ``kept``: packed winnowed grams, and for each length in ``short`` all grams of it."""
    hashed = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    grams = hashed.withColumn("grams", _grams(F.col("hashes"), K))
    own = [_grams(F.col("hashes"), k, k) for k in short]
    return grams.withColumn("kept", F.concat(_winnowed(F.col("grams"), W), *own) if own else _winnowed(F.col("grams"), W)).drop("grams", "hashes")


def _classes(bench: DataFrame, item_id: str, text: str) -> DataFrame:
    """(class, item, ids): distinct word lists and the ids of the items that have them."""
    items = bench.select(F.col(item_id).cast("string").alias("id"), words(F.col(text)).alias("item")).where(F.size("item") > 0)
    return cut(items.groupBy("item").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("class", F.monotonically_increasing_id()))


def hits(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs without their text, and n_words, spans (first words of hit windows, and lengths) and item_ids.

    Columns of docs that have one of these names are given up. Rows are numbered as docs gives them, which must be the
    same in a task that runs again: a scan, or a stored frame.
    """
    prepare(docs.sparkSession)
    own = [c for c in docs.columns if c not in (text, "n_words", "spans", "item_ids", "_row")]
    numbered = spread(docs.select(*own, text, F.monotonically_increasing_id().alias("_row")))
    base = numbered.select(F.struct(*own).alias("own") if own else F.struct(F.lit(None).alias("none")).alias("own"), words(F.col(text)).alias("words"), F.col("_row").alias("row"))
    classes = _classes(bench, item_id, item_text)
    size, members, lengths = classes.agg(F.sum(F.octet_length(F.array_join("item", " "))), F.sum(F.size("ids")), F.collect_set(F.when(F.size("item") < WINDOW, F.least(F.size("item"), F.lit(K))))).first()
    short = sorted(lengths)
    marks = classes.sparkSession.range(1).select(F.lit(_MARK).cast("long").alias("key"), F.lit(None).cast("long").alias("class"), F.lit(0).alias("q"))
    # Stored before it is exploded: the optimizer would else put a filter with all of its making, nested, below it.
    long_items = cut(_kept(classes.where(F.size("item") >= WINDOW).select("class", F.col("item").alias("words")), []).select("class", "kept")).select("class", F.explode("kept").alias("x"))
    prints = long_items.select(F.shiftright("x", _AT).alias("key"), "class", F.col("x").bitwiseAND((1 << _AT) - 1).cast("int").alias("q"))
    for k in short:
        firsts = classes.where((F.size("item") < WINDOW) & (F.least(F.size("item"), F.lit(K)) == k)).select("class", F.transform("item", lambda w: F.xxhash64(w)).alias("hashes"))
        prints = prints.unionByName(firsts.select(F.shiftright(_grams(F.col("hashes"), k, k)[0], _AT).alias("key"), "class", F.lit(0).alias("q")))
    shape = _kept(base.withColumn("n_words", F.size("words")), short).select("row", "own", "n_words", "words", F.explode(F.concat("kept", F.array(F.lit(_MARK).cast("long")))).alias("x"))
    met = shape.select("row", "own", "n_words", "words", F.shiftright("x", _AT).alias("key"), F.col("x").bitwiseAND((1 << _AT) - 1).cast("int").alias("p"))
    length = F.least(F.size("item"), F.lit(WINDOW))
    reach = F.when(F.size("item") < WINDOW, 0).otherwise(W - 1)
    same = lambda o: (
        (F.col("p") >= o) & (F.col("q") >= o) & (F.col("p") - o + length <= F.col("n_words")) & (F.col("q") - o + length <= F.size("item"))
        & (F.slice("words", F.greatest(F.col("p") - o + 1, F.lit(1)), length) == F.slice("item", F.greatest(F.col("q") - o + 1, F.lit(1)), length))
    )
    found = F.when(F.col("class").isNull(), F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.sequence(F.lit(0), reach), same), lambda o: F.col("p") - o))
    passes = []
    blocks = max(1, -(-(size or 0) // block))
    for i in range(blocks):
        mine = prints.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == i)
        mine = mine.unionByName(marks) if not i else mine
        texts = classes.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == i).select("class", "item")
        passes.append(met.join(F.broadcast(mine), "key").join(F.broadcast(texts), "class", "left").select("row", "own", "n_words", "class", found.alias("starts"), length.alias("length")))
    rows = passes[0]
    for x in passes[1:]:
        rows = rows.unionByName(x)
    verified = rows.where(F.col("class").isNull() | (F.size("starts") > 0)).repartition("row")
    once = verified.groupBy("row", "class", "length").agg(F.first("own").alias("own"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    ids = once.join(F.broadcast(classes.select("class", "ids")) if blocks == 1 and (members or 0) <= KEYS_SENT else classes.select("class", "ids"), "class", "left")
    spans = F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("length").alias("length")))
    out = ids.withColumn("spans", F.when(F.col("class").isNull(), F.array().cast("array<struct<start:int,length:int>>")).otherwise(spans)).groupBy("row").agg(
        F.first("own").alias("own"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("item_ids")
    )
    return out.select(*([f"own.`{c}`" for c in own]), "n_words", "spans", F.sort_array("item_ids").alias("item_ids"))


def _covered(spans: Column) -> Column:
    """Words in the union of the spans (start, length)."""
    empty = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(spans), empty, step, lambda a: a["n"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    counted = found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), _covered(F.col("spans")).cast("long").alias("n_hit"), "item_ids")
    return counted.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op6_decontamination": op6_decontamination}
_SPLIT = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op6_decontamination": f"""
with d as (select doc_id, {_SPLIT} as w from documents),
b as (select item_id, {_SPLIT} as w from benchmark),
bw as (select distinct item_id, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') as win, least(len(w), {WINDOW}) as k
       from b, range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1) t(i) where len(w) > 0),
ks as (select distinct k from bw),
dw as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as win from d, ks, range(1, len(w) - k + 2) t(i)),
m as (select doc_id, i, dw.k as k, item_id from dw join bw on dw.win = bw.win and dw.k = bw.k),
h as (select doc_id, count(distinct i + o) as n_hit from m, range(0, k) t(o) group by doc_id),
n as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, item_id::varchar as s from m) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join n using (doc_id)"""
}
