"""Document fingerprints of closed syncmers, in expressions only.

A text is a sequence of words. K words in a row are an anchor if the least hash among their inner
substrings of S words stands at one of their two ends. Whether it does depends on these words alone, so the
same passage has the same anchors in any document, at any place, and one at least in any K + W - 1 words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import saved, table
from changeflow.llm.order import key_text, numbered

#: Words of an inner substring, inner substrings of a window (a power of two), words of a window.
S, W = 2, 4
K = S + W - 1
#: Words end at white space; in scripts that write none, every character up to U+FFFF is a word.
BREAKS = r"\s+|(?<=[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uD7FF\uF900-\uFFEF])"
#: Anchors are 32 bits; above them a tag holds a bit for the side and 30 for the rank.
RANK = 1 << 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash32(*values: Column) -> Column:
    return F.xxhash64(*values).bitwiseAND(F.lit(0xFFFFFFFF))


def _closed(words: Column) -> Column:
    """The hashes of all windows of ``words`` that are anchors, in order."""
    run = lambda j, n: [F.get(words, j + k) for k in range(n)]
    windows = F.sequence(F.lit(0), F.size(words) - K)

    def chosen(inner: Column) -> Column:
        least, reach = inner, 1
        while reach < W:
            # Ends that lack a full window get too large a minimum; no window starts there.
            half = reach
            least = let(least, lambda m: F.zip_with(m, F.slice(m, half + 1, F.size(m)), lambda x, y: F.least(x, y)))
            reach *= 2
        at_edge = lambda m, j: (F.get(m, j) == F.get(inner, j)) | (F.get(m, j) == F.get(inner, j + (W - 1)))
        anchor = lambda m, j: F.when(at_edge(m, j), _hash32(*run(j, K)))
        return let(least, lambda m: F.array_compact(F.transform(windows, lambda j: anchor(m, j))))

    return let(F.transform(F.sequence(F.lit(0), F.size(words) - S), lambda j: F.xxhash64(*run(j, S))), chosen)


def anchors(text: Column) -> Column:
    """The anchors of a text in order, as unsigned 32-bit numbers; runs of one anchor count once.

    A text of under K words is its own anchor, white space included; an empty or null one has none.
    Equal texts have equal anchors. The words of one text are held at a time.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    none = F.array().cast("array<bigint>")
    found = let(F.array_remove(F.split(whole, BREAKS), ""), lambda w: F.when(F.size(w) >= K, _closed(w)).otherwise(none))
    found = let(found, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))
    alone = F.when(F.octet_length(whole) > 0, F.array(_hash32(whole))).otherwise(none)
    return let(found, lambda a: F.array_compact(F.when(F.size(a) > 0, a).otherwise(alone)))


def fingerprint(found: Column) -> Column:
    """Anchors as text: base64 of four bytes each."""
    packed = F.base64(F.unhex(F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x), 8, "0")), "")))
    return F.replace(packed, F.lit("\r\n"), F.lit(""))


def _tagged(found: Column) -> Column:
    """Each anchor, told apart from earlier equal ones by their number, with its rank; in the order of anchors."""

    def counted(tags: Column) -> Column:
        opens = F.filter(
            F.transform(tags, lambda x, i: F.when((i == 0) | (F.shiftright(x, 31) != F.shiftright(F.get(tags, i - 1), 31)), i)),
            lambda i: i.isNotNull(),
        )
        lengths = let(opens, lambda o: F.transform(o, lambda x, i: F.coalesce(F.get(o, i + 1), F.size(tags)) - x))
        number = F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))
        return F.zip_with(
            tags,
            number,
            lambda x, n: _hash32(F.shiftright(x, 31) * RANK + n) * (2 * RANK) + x.bitwiseAND(F.lit(RANK - 1)),
        )

    return F.sort_array(let(F.sort_array(F.transform(found, lambda x, i: x * (2 * RANK) + i)), counted))


def _likeness(left: Column, right: Column) -> Column:
    """Likeness of two documents, from their tagged anchors.

    Shared anchors are matched by position: the difference of an anchor's ranks in both documents is
    the same along a shared passage. A match counts if another one has the same difference (or if a
    document has a single anchor), so stray phrases don't. The rest is Jaccard's measure. Two empty
    documents are alike.
    """
    both = F.sort_array(F.concat(left, F.transform(right, lambda x: x + RANK)))
    rank = lambda x: x.bitwiseAND(F.lit(RANK - 1))
    shifts = let(
        both,
        lambda t: F.filter(
            F.transform(
                t,
                lambda x, i: F.when(
                    (i > 0) & (F.shiftright(x, 31) == F.shiftright(F.get(t, i - 1), 31)), rank(x) - rank(F.get(t, i - 1))
                ),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    backed = let(
        F.sort_array(shifts),
        lambda d: F.filter(
            d, lambda x, i: F.coalesce(x == F.get(d, i + 1), F.lit(False)) | ((i > 0) & (x == F.get(d, i - 1)))
        ),
    )
    least = F.least(F.size(left), F.size(right))
    shared = F.when(least == 1, F.size(shifts)).otherwise(F.size(backed))
    total = F.size(left) + F.size(right)
    return F.when(total == 0, 1.0).otherwise(let(shared, lambda m: m / (total - m)))


def likeness(left: Column, right: Column) -> Column:
    """From 0 to 1, how alike two documents are by their :func:`anchors`."""
    return _likeness(_tagged(left), _tagged(right))


def _small(found: Column) -> Column:
    """Anchors in four bytes each."""
    return F.transform(found, lambda x: (x - F.lit(1 << 31)).cast("int"))


def _wide(small: Column) -> Column:
    return F.array_compact(F.transform(small, lambda x: x.cast("long") + F.lit(1 << 31)))


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, own, head, following, times)``: each text with its anchors, and with the first
    characters (a quarter of its own number, or all) and the anchors of the text of the next row by id.

    After the last row comes the first. Null texts are empty; null ids come first; rows of one id go by a
    digest of their texts. Of equal rows each is followed by the next of them and only the last by another text:
    ``times`` says how often a row of the result stands. A single row follows itself. No rows give no
    rows. A text is shuffled once; to the row before it travel its head and its anchors alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), key_text(id_col).alias("k"), text.alias("text")).withColumn(
        "h", F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    )
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    ids = rows.groupBy("id", "k", "h").agg(F.count(F.lit(1)).alias("copies"), F.max(quarter).alias("tail"))
    ranked = saved(numbered(ids, ["id", "h"], "place"), "ranked")
    after = F.when(F.col("place") == 0, ranked.count()).otherwise(F.col("place")) - 1
    # The row before hands out its name and what it needs: to it the next row sends that.
    links = saved(
        ranked.join(ranked.select(after.alias("place"), F.col("k").alias("next_k"), F.col("h").alias("next_h")), "place"), "links"
    )
    texts = rows.groupBy("k", "h").agg(F.first("text").alias("text"))
    own = texts.join(links.select("id", "k", "h", "copies", "tail"), ["k", "h"])
    following = (
        texts.join(links.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), "tail"), ["k", "h"])
        .select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.left("text", F.col("tail")).alias("head"), _small(anchors(F.col("text"))).alias("small"))
    )
    copy = F.expr("array(struct(false AS again, 1L AS times), struct(true AS again, copies - 1 AS times))")
    both = own.join(following, ["k", "h"]).select("id", "text", "tail", "head", "small", F.inline(copy)).where("times > 0")
    both = both.select("id", "text", "tail", "head", "small", "again", "times", anchors(F.col("text")).alias("own"))
    return both.select(
        "id",
        "text",
        "own",
        F.when(F.col("again"), F.left("text", F.col("tail"))).otherwise(F.col("head")).alias("head"),
        F.when(F.col("again"), F.col("own")).otherwise(_wide(F.col("small"))).alias("following"),
        "times",
    )


def op11_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = successors(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 4).cast("int")), "head")
    pairs = pairs.select("id", "times", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "following")
    found = pairs.select(
        "id",
        "times",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own",
        anchors(F.col("edited")).alias("other"),
        "following",
    )
    tagged = found.select(
        "id", "times", "n_chars", "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        F.arrays_overlap("own", "following").alias("meet"),
        _tagged(F.col("own")).alias("own"),
        _tagged(F.col("other")).alias("other"),
        "following",
    )
    # Most neighbours share no anchor at all; only the others are matched by position.
    empty = (F.size("own") == 0) & (F.size("following") == 0)
    near_next = F.when(F.col("meet"), _likeness(F.col("own"), _tagged(F.col("following")))).otherwise(F.when(empty, 1.0).otherwise(0.0))
    done = tagged.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        _likeness(F.col("own"), F.col("other")).alias("near_edited"),
        near_next.alias("near_next"),
        F.sequence(F.lit(1), F.col("times")).alias("copies"),
    )
    return done.withColumn("copies", F.explode("copies")).drop("copies")
