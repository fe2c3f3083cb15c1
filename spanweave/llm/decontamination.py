"""Operator 1: documents that hold benchmark passages. DataFrame functions only.

Words are runs of letters and digits, lower-cased; a shingle is five consecutive words (an item with
fewer words is one shingle of its whole length). An item's window in a document has as many words
as the item.

1. Placing, by counts: a window as similar as asked shares at least ``need`` of its shingles with the item, whatever
   their order. So it holds one of the item's rarest shingles (all but ``need - 1`` of them; rare by the places
   in the documents), and only around those are the shared places looked up. Windows are all that hold
   ``need`` shared places and end in one (or start the document); the earliest best window is always among
   them. One that loses nothing and gains by a step to the right is left out, as it is not the best.
2. SimHash: each window and each item gets a 64-bit fingerprint, the majority of the bits of its
   shingles' hashes (sums of 16-bit lanes in longs, of 32-bit lanes from 65,536 shingles on). A repeated shingle has
   another hash at each occurrence, so that all features are distinct and the distance follows the weighted similarity.
3. Multi-index Hamming blocks: fingerprints are cut into ``RADIUS + 1`` blocks; two fingerprints
   within the radius agree in at least one, so an equi-join on (item, block number, block bits) finds all of
   them. Windows carry the item that placed them, so no window meets an item it shares little with; a pair is
   kept at its first equal block only.
4. Exact check: weighted Jaccard similarity of the shingles, weights being their counts.

A pair at similarity 0.8 differs in 9.7 of 64 bits on average; the radius lies 3.8 standard deviations
above that, and equal passages differ in none.

Items of equal words are handled once. The benchmark side is broadcast only if all its rows to be sent, shingles
and blocks, are within ``BROADCAST_ROWS``; beyond it the same joins are shuffled. Documents meet their windows
again on a hash of id and text.

Defined cases: null and empty texts hold and match nothing, on either side; null ids are carried
along; rows equal in id and text are found once; a document shorter than an item is one window; ties
go to the earliest window; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanweave.llm.common import fresh, stored

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 20
BITS = 64 // (RADIUS + 1)
BROADCAST_ROWS = 1 << 17


def bound(value: Column, body):
    """``body`` of the value as a lambda variable, so that the value is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))


def hashes_of(words: Column, width: int) -> Column:
    """Hashes of every ``width`` consecutive words, in order."""
    return bound(words, lambda w: F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    ).otherwise(F.array().cast("array<bigint>")))


def window_hashes(words: Column) -> Column:
    """Shingle hashes of a window or item; one of the whole if it is shorter than a shingle."""
    each = F.lit(None).cast("array<bigint>")
    for width in range(1, WIDTH):
        each = F.when(F.size(words) == width, hashes_of(words, width)).otherwise(each)
    return F.when(F.size(words) >= WIDTH, hashes_of(words, WIDTH)).otherwise(each)


def _majority(hashes: Column, lanes: int) -> Column:
    """Bits that most hashes have: plane j sums the bits j, j+w, j+2w ... of all hashes, in ``lanes`` lanes of w bits."""
    width = 64 // lanes
    ones = sum(1 << width * k for k in range(lanes))
    planes = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(
        hashes, F.lit(0).cast("bigint"),
        lambda a, h: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(ones))))
    lane = lambda s, k: F.shiftrightunsigned(s, width * k).bitwiseAND(F.lit((1 << width) - 1))
    bits = lambda s: F.array(*[F.when(lane(s, k) * 2 > F.size(hashes), F.lit(1 << width * k)
                                     ).otherwise(F.lit(0)).cast("bigint") for k in range(lanes)])
    return F.aggregate(F.transform(planes, lambda s, j: F.call_function(
        "shiftleft", F.aggregate(bits(s), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)), j)),
        F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def simhash(hashes: Column) -> Column:
    """Majority bits; lanes of 16 bits count up to 65,535 hashes, beyond it they have 32."""
    return F.when(F.size(hashes) < 1 << 16, _majority(hashes, 4)).otherwise(_majority(hashes, 2))


def counted(hashes: Column) -> Column:
    """Distinct hashes: a first occurrence stands as it is, another is hashed with its number, so that set sizes are
    weight sums."""
    return bound(F.array_sort(hashes), lambda s: F.transform(s, lambda h, i: F.when(
        F.get(s, i - 1) == h, F.xxhash64(h, i - F.array_position(s, h).cast("int"))).otherwise(h)))


def fingerprint(hashes: Column) -> Column:
    """SimHash of occurrence-numbered hashes."""
    return bound(F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(counted(hashes)), simhash)


def _block(fp: Column, j: Column) -> Column:
    """Bits of block j; the last one also holds what is left over."""
    moved = F.call_function("shiftrightunsigned", fp, (j * BITS).cast("int"))
    return F.when(j == RADIUS, moved).otherwise(moved.bitwiseAND(F.lit((1 << BITS) - 1)))


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, ik, size, width, hashes) of every item with words, equal rows once; items of equal words have one ``ik``."""
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(
        "size(words) > 0").distinct()
    items = items.select("item", F.size("words").alias("size"), F.least(F.size("words"), F.lit(WIDTH)).alias("width"),
                         window_hashes(F.col("words")).alias("hashes"))
    return items.withColumn("ik", F.xxhash64("size", "hashes"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _shared_places(words: DataFrame, texts: DataFrame, widths: list, ready) -> DataFrame:
    """``rk, n, width, pos, h``: places of a document whose shingle is one of the benchmark's."""
    def placed(width: int) -> Column:
        return F.transform(hashes_of(F.col("words"), width), lambda h, i: F.struct(
            i.alias("pos"), F.lit(width).alias("width"), h.alias("h")))

    parts = [placed(width) for width in widths] or [F.array().cast("array<struct<pos:int,width:int,h:bigint>>")]
    each = words.select("rk", F.size("words").alias("n"), F.inline(F.concat(*parts)))
    known = texts.select("width", F.explode("hashes").alias("h")).distinct()
    return each.join(ready(known), ["h", "width"], "left_semi").distinct()


def _starts(similarity: float) -> Column:
    """Starts of the windows that can be as similar as asked, from the sorted shared places ``hits``."""
    return F.expr(f"""
        transform(array(named_struct(
            'places', transform(hits, x -> x.pos),
            'need', cast(ceil({similarity!r} * (s + IF(n < size, n - width + 1, s)) / (1 + {similarity!r}) - 1e-9) as int))),
          p -> CASE
            WHEN n < size THEN IF(size(hits) >= p.need, array(0), cast(array() as array<int>))
            WHEN s = 1 THEN array(p.places[0])
            ELSE array_distinct(concat(
              IF(get(p.places, p.need - 1) < s, array(0), cast(array() as array<int>)),
              filter(transform(hits, (x, i) -> IF(
                  x.pos - s + 1 >= 0 AND get(p.places, i - p.need + 1) > x.pos - s
                  AND NOT coalesce(get(p.places, i + 1) = x.pos + 1
                                   AND coalesce(get(hits, i + 1).prev, -1) < x.pos - s + 1
                                   AND NOT array_contains(p.places, x.pos - s + 1), false),
                  x.pos - s + 1, CAST(NULL AS INT))), x -> x IS NOT NULL))) END)[0]""")


def place_windows(hits: DataFrame, texts: DataFrame, levels: list, similarity: float, ready) -> DataFrame:
    """``rk, ik, size, start``: the windows that can be as similar to an item as asked."""
    each = texts.select("ik", "size", "width", "s", "level", F.explode("hashes").alias("h"))
    places = hits.groupBy("width", "h").agg(F.count(F.lit(1)).alias("places"))
    rare = each.join(places, ["width", "h"], "left").withColumn("k", F.row_number().over(
        Window.partitionBy("ik").orderBy(F.coalesce("places", F.lit(0)), "h")))
    rare = rare.where(F.col("places").isNotNull() & (
        F.col("k") <= F.col("s") - F.ceil(F.col("s") * similarity - 1e-9) + 1)).select("ik", "level", "width", "h").distinct()
    # blocks of 2^level places, at least as long as the item: a window lies in those beside a rare place
    block = lambda level: F.call_function("shiftright", F.col("pos"), level)
    near = hits.join(ready(rare), ["width", "h"]).select("rk", "ik", "level", F.explode(F.array(
        *[block(F.col("level")) + k for k in (-1, 0, 1)])).alias("block")).distinct()
    at = hits.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels] or [F.lit(0)]))).withColumn(
        "block", block(F.col("level")))
    seeds = each.drop("level").distinct()
    found = at.join(near, ["rk", "level", "block"]).join(ready(seeds), ["ik", "width", "h"])
    found = found.select("rk", "ik", "n", "size", "width", "s", "pos", F.lag("pos").over(
        Window.partitionBy("rk", "ik", "h").orderBy("pos")).alias("prev"))
    found = found.groupBy("rk", "ik", "n", "size", "width", "s").agg(
        F.array_sort(F.collect_list(F.struct("pos", "prev"))).alias("hits"))
    return found.select("rk", "ik", "size", F.explode(_starts(similarity)).alias("start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``rk, id, item, start, n_words, similarity, hamming``: the best window of each document and item."""
    items = stored(benchmark_items(benchmark, item_col, item_text_col), "items")
    texts = items.drop("item").dropDuplicates(["ik"]).withColumn("s", F.size("hashes"))
    texts = texts.withColumn("level", F.ceil(F.log2("s")).cast("int")).withColumn("fp", fingerprint(F.col("hashes")))
    texts = stored(texts, "item-texts")
    shape = texts.agg(F.coalesce(F.sum(F.col("s") + RADIUS + 1), F.lit(0)).alias("rows"), F.collect_set("width").alias("widths"),
                      F.collect_set("level").alias("levels")).first()
    ready = F.broadcast if shape["rows"] <= BROADCAST_ROWS else (lambda df: df)

    d = docs.select(row_key(id_col, text_col).alias("rk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = d.select("rk", words_of(F.col("text")).alias("words"))
    hits = stored(_shared_places(words, texts, sorted(shape["widths"]), ready), "hits")
    windows = place_windows(hits, texts, sorted(shape["levels"]), similarity, ready)
    windows = stored(windows.groupBy("rk").agg(F.collect_list(F.struct("ik", "size", "start")).alias("windows")), "windows")

    held = d.join(windows, "rk").dropDuplicates(["rk"]).select("rk", "id", "windows", words_of(F.col("text")).alias("words"))
    cut = held.select("rk", "id", F.inline(F.transform("windows", lambda w: F.struct(
        w["ik"].alias("ik"), w["size"].alias("size"), w["start"].alias("start"),
        F.slice("words", w["start"] + 1, w["size"]).alias("w")))))
    cut = cut.select("rk", "id", "ik", "size", "start", window_hashes(F.col("w")).alias("hashes")).withColumn(
        "fp", fingerprint(F.col("hashes")))
    cut = stored(cut, "prints")

    blocks = F.sequence(F.lit(0), F.lit(RADIUS))
    left = cut.withColumn("j", F.explode(blocks)).withColumn("bits", _block(F.col("fp"), F.col("j")))
    right = texts.select("ik", F.col("fp").alias("item_fp"), F.explode(blocks).alias("j")).withColumn(
        "bits", _block(F.col("item_fp"), F.col("j")))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    first = F.array_min(F.filter(blocks, lambda j: _block(F.col("fp"), j) == _block(F.col("item_fp"), j)))
    pairs = left.join(ready(right), ["ik", "j", "bits"]).where((far <= RADIUS) & (first == F.col("j")))
    pairs = pairs.join(ready(texts.select("ik", F.col("hashes").alias("item_hashes"))), "ik")
    both = F.size(F.array_intersect(counted(F.col("hashes")), counted(F.col("item_hashes"))))
    pairs = pairs.withColumn("hamming", far).withColumn("both", both).withColumn(
        "similarity", F.col("both") / (F.size("hashes") + F.size("item_hashes") - F.col("both")))
    best = pairs.where(F.col("similarity") >= similarity).groupBy("rk", "id", "ik").agg(F.max(F.struct(
        "similarity", (-F.col("start")).alias("s"), F.col("size").alias("n"), "hamming")).alias("m"))
    best = best.join(items.select("ik", "item"), "ik")
    return best.select("rk", "id", "item", (-F.col("m.s")).cast("bigint").alias("start"),
                       F.col("m.n").cast("bigint").alias("n_words"), F.col("m.similarity").alias("similarity"),
                       F.col("m.hamming").alias("hamming"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options).select("rk").distinct()
    rk = fresh(docs, "_rk")
    return docs.withColumn(rk, row_key(id_col, text_col)).join(bad.withColumnRenamed("rk", rk), rk, "left_anti").drop(rk)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", "similarity",
                        "hamming")
