"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document that is similar enough to an item has at least so many of its shingles, in whatever
order, as the similarity asks for. Windows are laid at every start that reaches this number (no window is lost
by that); a document shorter than the item is one window. Each window and item has a 64-bit
SimHash over its weighted shingles. Fingerprints meet through multi-index blocks: 64 bits in radius + 1
blocks, so two fingerprints within the radius agree on a block at least; what is within the radius is then
verified by exact weighted-shingle similarity. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words in a shingle, and the least similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits allowed: at similarity 0.8 about 10 of 64 differ on average, 20 or fewer in all but 1 of 5000 cases.
RADIUS = 20
#: Up to so many item shingles (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _hashes(w: Column, k: int) -> Column:
    """Hash of the k words from each place on; empty for fewer than k words."""
    n = F.size(w)
    each = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), each)).otherwise(F.array().cast("array<bigint>"))


def _shingles(w: Column, k: int) -> Column:
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of shingle hashes; a shingle weighs as often as it occurs."""
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda v, b: v.bitwiseOR(F.when(bit(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """array of (block, value): the 64 bits in radius + 1 blocks of nearly equal width."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft(fingerprint, 64 - cuts[i + 1]), 64 - cuts[i + 1] + cuts[i]).alias("value")) for i in range(n)])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle arrays: minima over maxima of how often each shingle occurs."""
    count = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(count(a, s), count(b, s))))
    total = F.size(a) + F.size(b) - common
    return F.when(total > 0, common / total).otherwise(F.lit(0.0))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): each document and item with a window of the item's
    length in words, or the whole of a shorter document, whose similarity is ``least`` or more; the best window,
    the first of equals.

    Items of fewer than k words have no shingles and match nothing, like null texts. Items with equal text
    all match. Rows with the same id but other texts are compared each; the best window of the id is its row. A null
    id is an id like another. Repeated rows add nothing. Other columns are not read.
    """
    found = _matches(docs, benchmark, k, least, radius, id_col, text_col, item_col, item_text_col)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("sim", (-F.col("start")).alias("neg"), "size")).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.neg")).alias("start_word"), F.col("x.size").alias("n_words"), F.col("x.sim").alias("similarity"))


def _matches(docs, benchmark, k, least, radius, id_col, text_col, item_col, item_text_col) -> DataFrame:
    """(doc_id, key, item_id, start, size, sim) of every window that is similar enough; key is the text's digest."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).where(F.size("w") >= k).select("item_id", F.size("w").alias("size"), _hashes(F.col("w"), k).alias("h"), _shingles(F.col("w"), k).alias("sh"))
    items = stored(items.select("item_id", "size", "h", "sh", simhash(F.col("h")).alias("print")), "items")
    anchors = stored(items.select("size", F.explode("h").alias("hash")).distinct(), "anchors")
    rows = anchors.count()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    d = texts.select("doc_id", "key", words(F.col("text")).alias("w"))
    d = d.select("doc_id", "key", F.size("w").alias("n"), _hashes(F.col("w"), k).alias("h"))
    # outer: else a filter on the array goes down to where its expression is worked out again for each place
    at = d.select("doc_id", "key", "n", F.posexplode_outer("h").alias("pos", "hash"))
    hits = at.join(F.broadcast(anchors) if rows <= BROADCAST_ROWS else anchors, "hash")
    places = hits.groupBy("doc_id", "key", "n", "size").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    span = F.least(F.col("n"), F.col("size"))  # words of a window
    # common / (a + b - common) >= least, for a shingles of the window and b of the item
    need = F.greatest(F.lit(1), F.ceil(least * (span + F.col("size") - 2 * (k - 1)) / (1 + least) - 1e-9).cast("int"))
    # need places of shingles from the i-th on lie in a window that starts at or before the i-th and ends with or after the last of them
    low = lambda i: F.greatest(F.lit(0), F.get("p", i + F.col("need") - 1) - F.col("span") + k)
    high = lambda i: F.least(F.get("p", i), F.col("n") - F.col("span"))
    starts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(F.array().cast("array<int>"))))
    windows = places.select("*", span.alias("span"), need.alias("need")).where(F.size("p") >= F.col("need"))
    windows = stored(windows.select("doc_id", "key", "size", "span", F.array_distinct(starts).alias("starts")), "windows")

    has = windows.select(F.col("doc_id").alias("d"), F.col("key").alias("y"), "size", "span", "starts")
    has = has.groupBy("d", "y").agg(F.collect_list(F.struct("size", "span", "starts")).alias("at"))  # windows of one text
    there = texts.join(has, texts["doc_id"].eqNullSafe(has["d"]) & (texts["key"] == has["y"]))
    there = there.select("doc_id", "key", words(F.col("text")).alias("w"), "at").select("doc_id", "key", "w", F.explode("at").alias("at"))
    there = there.select("doc_id", "key", "w", "at.size", "at.span", F.explode("at.starts").alias("start"))
    there = there.select("doc_id", "key", "start", "size", F.slice("w", F.col("start") + 1, F.col("span")).alias("w"), "span")
    there = there.select("doc_id", "key", "start", "size", "span", _shingles(F.col("w"), k).alias("sh"), _hashes(F.col("w"), k).alias("h"))
    prints = stored(there.select("doc_id", "key", "start", "size", "span", "sh", "h", simhash(F.col("h")).alias("print")).distinct(), "prints")  # h twice, else it's worked out again for each bit

    mine = prints.select("doc_id", "key", "start", "size", "print", F.explode(blocks(F.col("print"), radius)).alias("b")).select("doc_id", "key", "start", "size", "print", "b.*")
    theirs = items.select("item_id", "size", F.col("print").alias("other"), F.explode(blocks(F.col("print"), radius)).alias("b")).select("item_id", "size", "other", "b.*")
    near = mine.join(theirs, ["size", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= radius)
    near = near.select("doc_id", "key", "start", "size", "print", "item_id").distinct()
    found = near.join(items.select("item_id", "size", F.col("sh").alias("theirs")), ["item_id", "size"])
    mine = prints.select(F.col("doc_id").alias("d"), F.col("key").alias("y"), F.col("start").alias("s"), F.col("size").alias("z"), "span", "sh")
    found = found.join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("y")) & (F.col("start") == F.col("s")) & (F.col("size") == F.col("z")))
    return found.select("doc_id", "key", "item_id", "start", F.col("span").alias("size"), similarity(F.col("sh"), F.col("theirs")).alias("sim")).where(F.col("sim") >= least)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text has no benchmark item in it, with docs' own columns; a row goes by its text's 64-bit
    digest, so others that share its id stay."""
    found = _matches(docs, benchmark, SHINGLE, SIMILARITY, RADIUS, "doc_id", "text", "item_id", "text").select(F.col("key").alias("__found")).distinct()
    return docs.join(found, F.xxhash64("text") == F.col("__found"), "left_anti")
