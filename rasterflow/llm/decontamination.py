"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of consecutive words of a benchmark item (10, or all words of a shorter
item). It is taken as the set of its word shingles, each with its place. A document holds
the window where enough words agree in order. A window with ``need`` of its n words in
place keeps all but ``s * (n - need)`` of its shingles of s words, so among any
``s * (n - need) + 1`` of them one is in the document. Shingles are ordered by their
number of occurrences in all documents, and each window is joined on so many of its rarest
ones only: on a single one where all words have to agree.

A shingle's place in the window says where the window would begin in the document. Places
before the document's first word and past its last are ruled out, and the words of the
item-sized stretch are compared one by one. Windows that are joined on the same occurrence
overlap in it, so an occurrence gives one stretch of hit words, however many windows it
completes; windows of the same items are told apart no further.

Everything is DataFrame functions. Documents are scanned with the benchmark's shingles as
the broadcast side, in blocks of bounded size; what is shuffled are the stretches that were
hit. No text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, written

#: Words of a window and of its shingles.
WINDOW, SHINGLE = 10, 3
#: Shingles of the benchmark that are broadcast at once (a few hundred bytes each); more are joined in blocks.
BROADCAST_ROWS = 50_000
#: Windows that stand in one row of the broadcast side.
ROW_WINDOWS = 256


def words_of(text: Column) -> Column:
    """The words of a text, runs of letters, digits and all that is not ASCII, with A-Z lower-cased; null has none."""
    return plain_words(ascii_lower(F.coalesce(text, F.lit(""))), r"\x00-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F")


def plain_words(text: Column, others: str) -> Column:
    """``text`` cut at spaces and ``others``. A split at one plain character is much faster than a search for words."""
    return F.array_remove(F.split(F.regexp_replace(text, f"[{others}]+", " "), " ", -1), "")


def needed(n: Column, containment: float) -> Column:
    """Words of a window of ``n`` that have to agree."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(containment) - 1e-9)).cast("int")


def windows(benchmark: DataFrame, item_id: str, text: str, window: int, containment: float) -> DataFrame:
    """``(win, words, n, need, width, items)``: every different window with the sorted set of items that hold it."""
    item = F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item")
    rows = benchmark.select(item, words_of(F.col(text)).alias("all")).where(F.size("all") > 0).withColumn("n", F.least(F.lit(window), F.size("all")))
    starts = F.sequence(F.lit(1), F.size("all") - F.col("n") + 1)
    cut = rows.select("item", "n", F.explode(F.transform(starts, lambda s: F.slice("all", s, F.col("n")))).alias("words"))
    each = cut.groupBy("words", "n").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("need", needed(F.col("n"), containment))
    # so short that some shingle is left when all words that may differ do
    width = F.greatest(F.lit(1), F.least(F.lit(SHINGLE), F.expr("n div (n - need + 1)"))).cast("int")
    return each.select(F.md5(F.array_join("words", " ")).alias("win"), "words", "n", "need", width.alias("width"), "items")


def shingle(words: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from place ``at`` (counted from 0); past the end of fewer."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)])


def occurrences(docs: DataFrame, words: str, widths: list[int], token: str, at: str) -> DataFrame:
    """``docs`` with each place ``at`` of its words and the shingle ``token`` there, for each of ``widths``."""
    placed = docs.select("*", F.posexplode(words).alias(at, f"{token}_word")).drop(f"{token}_word")
    hashes = [shingle(F.col(words), F.col(at), w) for w in widths]
    return placed.withColumn(token, hashes[0]) if len(hashes) == 1 else placed.select("*", F.explode(F.array(*hashes)).alias(token))


def blocks(table: DataFrame, token: str) -> list[DataFrame]:
    """A written table in parts small enough to broadcast, cut by ``token``."""
    n = -(-table.count() // BROADCAST_ROWS) or 1
    return [F.broadcast(table if n == 1 else table.where(F.pmod(F.col(token), F.lit(n)) == k)) for k in range(n)]


def prefix_table(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, text: str, window: int, containment: float) -> tuple[DataFrame, DataFrame, list[int]]:
    """What documents are joined with: ``(token, wins)``, the classes ``(class, items)``, and the widths of shingles.

    ``wins`` are the windows that are joined on the token, with the token's place in each.
    """
    wins = written(windows(benchmark, item_id, item_text, window, containment).withColumn("class", F.md5(F.array_join("items", ","))), "windows")
    widths = sorted(r.width for r in wins.select("width").distinct().collect()) or [1]  # up to SHINGLE rows
    by_width = reduce(lambda a, w: a.when(F.col("width") == w, F.transform(F.sequence(F.lit(0), F.col("n") - w), lambda i: F.struct(i.cast("int").alias("at"), shingle(F.col("words"), i, w).alias("token")))), widths, F.when(F.lit(False), None))
    spread = wins.select("win", "n", "need", "width", F.explode(by_width).alias("t")).select("win", "n", "need", "width", "t.at", "t.token")
    vocabulary = written(spread.select("token").distinct(), "vocabulary")
    told = docs.select(words_of(F.col(text)).alias("words"))
    counted = [occurrences(told, "words", widths, "token", "at").join(b, "token").groupBy("token").agg(F.count("*").alias("times")) for b in blocks(vocabulary, "token")]
    times = written(reduce(DataFrame.unionAll, counted), "frequencies")
    ordered = spread.join(times, "token", "left").groupBy("win", "n", "need", "width").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token", "at"))).alias("tokens"))
    prefix = F.slice("tokens", 1, (F.col("width") * (F.col("n") - F.col("need")) + 1).cast("int"))
    # a shingle that no document has can't be met
    rare = ordered.select("win", F.explode(prefix).alias("t")).where("t.times > 0").select("win", "t.token", "t.at")
    whole = rare.join(wins.select("win", "words", "n", "need", "class"), "win")
    share = F.count("*").over(Window.partitionBy("token"))
    lane = F.pmod(F.xxhash64("win"), F.ceil(share / ROW_WINDOWS).cast("long"))
    table = whole.withColumn("lane", lane).groupBy("token", "lane").agg(F.collect_list(F.struct("at", "n", "need", "words", "class")).alias("wins")).drop("lane")
    return written(table, "prefixes"), wins.groupBy("class").agg(F.first("items").alias("items")), widths


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, containment: float = 1.0) -> DataFrame:
    """``docs`` with ``n_words``, ``spans``, ``n_hit`` and ``items``.

    ``spans`` are the stretches of words that windows of items hit: ``(lo, hi)``, counted
    from 0, the end left out, sorted and apart from each other. ``n_hit`` is their length
    and ``items`` the sorted items whose windows occur. A window occurs where
    ``containment`` of its words, all of them by default, agree in order with a stretch of
    as many words. Null and empty texts have no words, and items without words no windows;
    an item without id is named by the empty text, rows with one id are one item. Rows
    repeated with id and text are treated alike. Other columns pass; those named like a
    result are replaced. An empty table gives an empty result, an empty benchmark no hits.
    """
    results = ("n_words", "spans", "n_hit", "items")
    keep = docs.drop(*[c for c in docs.columns if c.lower() in results])
    key, words, at, token, wins, near, left = fresh(keep, "_key", "_words", "_at", "_token", "_wins", "_near", "_left")
    own = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), F.coalesce(F.col(text), F.lit("")))))
    table, classes, widths = prefix_table(docs, benchmark, item_id, item_text, text, window, containment)
    told = docs.select(own.alias(key), words_of(F.col(text)).alias(words))
    begins = lambda w: F.col(at) - w["at"]

    def occurs(w: Column) -> Column:
        """Whether the window that has the shingle at its place ``w.at`` is in the document there."""
        start = begins(w) - F.col(left)
        inside = (begins(w) >= 0) & (start + w["n"] <= F.size(near))
        agree = F.zip_with(F.slice(near, start + 1, w["n"]), w["words"], lambda a, b: a == b)
        return F.when(inside, F.size(F.filter(agree, lambda x: x)) >= w["need"]).otherwise(F.lit(False))

    met = []
    for block in blocks(table, "token"):
        joined = occurrences(told, words, widths, token, at).join(block.withColumnsRenamed({"wins": wins, "token": f"{token}_b"}), F.col(token) == F.col(f"{token}_b"))
        # a generator is what the filter on its output can't be moved below: rows leave the join with the words around the shingle, not with all words
        first = F.greatest(F.col(at) - (window - 1), F.lit(0))
        around = joined.select(key, at, wins, first.alias(left), F.explode(F.array(F.slice(words, first + 1, F.lit(2 * window + SHINGLE)))).alias(near))
        hit = around.select(key, at, F.filter(wins, occurs).alias(wins)).where(F.size(wins) > 0)
        lo, hi = F.array_min(F.transform(wins, begins)), F.array_max(F.transform(wins, lambda w: begins(w) + w["n"]))
        met.append(hit.select(key, lo.alias("lo"), hi.alias("hi"), F.array_distinct(F.transform(wins, lambda w: w["class"])).alias("classes")))
    hits = written(reduce(DataFrame.unionAll, met), "hits")
    stretches = hits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("s"))
    kind = "array<struct<lo:int,hi:int>>"

    def unite(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        return F.when(F.size(done) == 0, F.array(x)).when(x["lo"] > last["hi"], F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown)))

    spans = stretches.select(key, F.aggregate(F.col("s").cast(kind), F.array().cast(kind), unite).alias("spans"))
    named = hits.select(key, F.explode("classes").alias("class")).distinct().join(classes, "class").groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = written(spans.join(named, key).select(F.col(key).alias(f"{key}_b"), "spans", "items"), "contaminated")
    n_words = F.size(plain_words(F.coalesce(F.col(text), F.lit("")), r"\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F")).cast("long")
    rows = keep.select("*", own.alias(key), n_words.alias("n_words")).join(found, F.col(key) == F.col(f"{key}_b"), "left").drop(key, f"{key}_b")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return rows.withColumns({"spans": F.coalesce("spans", F.array().cast(kind)), "n_hit": F.coalesce(n_hit, F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` of whose words no more than ``share`` are hit; rows without words stay."""
    names = fresh(docs, "_n_words", "_n_hit")
    marked = contamination(docs.select(F.struct("*").alias("row"), F.col(options.get("doc_id", "doc_id")).alias("doc_id"), F.col(options.get("text", "text")).alias("text")), benchmark, **{k: v for k, v in options.items() if k not in ("doc_id", "text")})
    rows = marked.select("row.*", F.col("n_words").alias(names[0]), F.col("n_hit").alias(names[1]))
    return rows.where(F.col(names[1]) <= F.col(names[0]) * F.lit(share)).drop(*names)
