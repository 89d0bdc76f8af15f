"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text is the set of digests of its paragraphs. They are its lines; a long line is cut where its content says so, after
words whose hash is divisible by the mean length wanted, so that an insertion changes the pieces around it only. Short
texts are cut by content too, and finer (``TIERS``), so that they have enough digests to tell how much two of them
share; near a tier's end a text has the pieces of both tiers, so that versions on either side of it still compare. Each digest is put
into one cell of each of three tables (count, XOR of digests, XOR of check values). Subtracting two versions' cells
cancels what both hold; peeling cells that hold one digest then recovers the digests that differ, at a cost that follows
the difference and not the texts. Where peeling gets stuck, the pair is taken again with tables ``GROW`` times as large.
The likeness of two texts is shared / all distinct digests, from the number recovered. The fingerprint is the sketch of
the first size as text.

The next document's text comes from a window over ranges of doc_id: approximate quantiles deal the ids to many ranges of
about equal size, and the first document of each range is sent to the range before it as well. No sort of the whole.

Defined cases: null and empty texts are the same empty set, alike with likeness 1; texts without words but with white
space have a digest too; a null doc_id comes first in the order; rows that share a doc_id are ordered by a hash of the text; a
single document is its own next one; an empty table gives an empty result; other columns are left out of the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.shared import partitions, read, staged

#: Texts up to so many characters are cut into pieces of so many words on average, longer ones (None) at their lines.
TIERS = ((256, 1), (1024, 8), (None, None))
#: Lines of so many characters or more are cut into pieces of so many words on average.
LONG, PIECE = 512, 64
#: The first characters of a longer text are a paragraph too, so that an edit further on leaves one at least.
HEAD = 64
#: A text within this factor of a tier's end has the pieces of both tiers.
OVERLAP = 1.25
#: A word with the white space behind it, or white space at the beginning.
TOKEN = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+|^[\x20\x09-\x0D]++"
MARK = "\x01"
FIRST, GROW, LAST = 8, 2, 2048  # cells of a table at first; factor for each retry; cells at most
WIDE, PART = 128, 64  # cells from which a pair is taken in parts; digests of a part


def pieces(text: Column, words: int) -> Column:
    """Runs of words that end where a word's hash is divisible by ``words``: an insertion moves no cut but its own. White space goes with the word before it."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    if words == 1:
        return tokens
    marked = F.transform(tokens, lambda t: F.when(F.pmod(F.xxhash64(t), F.lit(words)) == 0, F.concat(t, F.lit(MARK))).otherwise(t))
    return F.filter(F.split(F.array_join(marked, ""), MARK, -1), lambda p: p != "")


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text: its lines, long ones in pieces, or pieces of a short text; none of an empty text."""
    t = F.coalesce(text, F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    n, low = F.char_length(t), 0.0
    parts = [F.when(n > 2 * HEAD, F.array(F.concat(F.lit("head:"), F.substring(t, 1, HEAD)))).otherwise(none)]
    for most, words in TIERS:
        inside = (n > low / OVERLAP) & (n <= most * OVERLAP if most else F.lit(True))
        if words is None:
            lines = F.flatten(F.transform(F.split(t, "\n", -1), lambda x: F.when(F.char_length(x) < LONG, F.array(x)).otherwise(pieces(x, PIECE))))
            parts.append(F.when(inside, lines).otherwise(none))
        else:  # the same words in pieces of another tier are not the same paragraph
            parts.append(F.when(inside, F.transform(pieces(t, words), lambda p: F.concat(F.lit(f"{words}:"), p))).otherwise(none))
        low = float(most or 0)
    return F.array_distinct(F.transform(F.concat(*parts), lambda p: F.xxhash64(p)))


def check_of(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _keys(digest_array: Column, size: int) -> Column:
    """Digests with their check and their cell in each of the three tables: other bits of the digest for each."""
    return F.transform(digest_array, lambda d: F.struct(
        d.alias("k"), check_of(d).alias("h"), F.lit(1).alias("n"), *_places(d, size)))


def _places(digest: Column, size: int) -> list[Column]:
    return [F.pmod(F.shiftrightunsigned(digest, shift), F.lit(size)).cast("int").alias(name) for name, shift in (("a", 0), ("b", 21), ("c", 42))]


def _add(keys: Column, start: Column, sign: int) -> Column:
    return F.aggregate(keys, start, lambda c, x: F.struct(
        (c["n"] + x["n"] * sign).alias("n"), c["k"].bitwiseXOR(x["k"]).alias("k"), c["h"].bitwiseXOR(x["h"]).alias("h")))


EMPTY = "named_struct('n', 0, 'k', 0L, 'h', 0L)"


def _once(value: Column, f) -> Column:
    """f of a value that is worked out once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def cells(digest_array: Column, size: int) -> Column:
    """The sketch: three tables of ``size`` cells, one after the other."""

    def table(keys: Column, t: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: _add(F.filter(keys, lambda x: x[t] == i), F.expr(EMPTY), 1))

    return _once(_keys(digest_array, size), lambda keys: F.concat(*(table(keys, t) for t in "abc")))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(difference: Column, size: int, rounds: int = 30) -> Column:
    """Struct (cells, found, going): the digests that the difference of two sketches gives up, and the cells left."""
    start = F.struct(difference.alias("cells"), F.expr("cast(array() as array<bigint>)").alias("found"), F.lit(True).alias("going"))

    def step(s: Column, _: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (check_of(c["k"]) == c["h"]))
        keys = F.array_distinct(F.transform(pure, lambda c: F.struct(c["k"].alias("k"), c["h"].alias("h"), c["n"].alias("n"), *_places(c["k"], size))))

        def taken(ks: Column, t: str, lo: int) -> Column:
            return F.transform(F.slice(s["cells"], lo + 1, size), lambda c, i: _add(F.filter(ks, lambda x: x[t] == i), c, -1))

        rest = _once(keys, lambda ks: F.when(F.size(ks) == 0, F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(False).alias("going"))).otherwise(F.struct(
            F.concat(*(taken(ks, t, n * size) for n, t in enumerate("abc"))).alias("cells"),
            F.concat(s["found"], F.transform(ks, lambda x: x["k"])).alias("found"), F.lit(True).alias("going"))))
        return F.when(s["going"], rest).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def printed(cell_array: Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(cell_array, lambda c: F.concat_ws(":", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["h"]))), " ")


def peeled(left: Column, right: Column, size: int) -> Column:
    """The digests on one side only, from two sketches of this size; null where peeling does not end with empty cells."""
    return _once(peel(subtract(left, right), size), lambda s: F.when(
        F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0)), s["found"]))


def wanted_size(left: Column, right: Column, surplus: Column, size: int) -> Column:
    """Cells a table needs, estimated from the counts in the difference of two sketches of ``size``.

    Digests of either side fall into cells at random with opposite signs, so the squares of the counts of a table add
    up to about the number of differing digests, plus the square of the surplus over the cells.
    """
    squares = F.aggregate(subtract(left, right), F.lit(0).cast("long"), lambda s, c: s + c["n"] * c["n"])
    number = (squares / 3 - surplus * surplus / size) * size / (size - 1)
    return F.greatest(number * 0.45, F.abs(surplus) * 0.4)


def differing(rows: DataFrame, left: str, rights: dict[str, str], printing: tuple[str, ...] = (), number: str = "__row") -> DataFrame:
    """``rows`` plus, for each name in ``rights``, the digests on one side only of the digest arrays ``left`` and that one.

    The first job estimates from the sketches of the first size the size each pair wants, and peels what is small enough.
    The next jobs, each with tables ``GROW`` times as large, take the rows whose pairs want their size or failed at a
    smaller one; what succeeds stays in the written table of its job. Pairs that want more than ``WIDE`` cells are taken
    in parts. ``printing``: digest arrays whose sketches of the first size come as text;
    ``number``: a name for the rows' numbers in the first job's table, so that parts need no table of their own. What is not peeled with ``LAST`` cells, as good as never anything, is compared digest by digest.
    """
    kept, size = rows.columns, FIRST
    missing = F.lit(False)
    for n in rights:
        missing = missing | F.col(n).isNull()
    surplus = {n: (F.array_size(left) - F.array_size(c)).cast("double") for n, c in rights.items()}
    sketched = rows.select("*", *(cells(F.col(c), size).alias(f"sketch_{c}") for c in (left, *rights.values())))
    sized = sketched.select("*", *(wanted_size(F.col(f"sketch_{left}"), F.col(f"sketch_{c}"), surplus[n], size).alias(f"{n}_size") for n, c in rights.items()))
    first = sized.select(*kept, F.monotonically_increasing_id().alias(number), *(printed(F.col(f"sketch_{c}")).alias(f"printed_{c}") for c in printing),
                         *(F.when(F.col(f"{n}_size") <= size, peeled(F.col(f"sketch_{left}"), F.col(f"sketch_{c}"), size)).alias(n) for n, c in rights.items()), *(f"{n}_size" for n in rights))
    kept = [c for c in first.columns if c not in rights and c not in {f"{n}_size" for n in rights}]
    tried = staged(first, f"fingerprint-{size}")
    done, todo = [tried.filter(~missing).select(*kept, *rights)], tried.filter(missing)
    wide = F.greatest(*(F.when(F.col(n).isNull(), F.col(f"{n}_size")).otherwise(F.lit(0.0)) for n in rights), F.lit(0.0)) > WIDE
    if not (far := todo.filter(wide)).isEmpty():
        done.append(_in_parts(far, left, rights, number).select(*kept, *rights))
        todo = todo.filter(~wide)
    while size < LAST and not todo.isEmpty():
        size *= GROW
        again = (F.when(F.col(n).isNotNull(), F.col(n)).when(F.col(f"{n}_size") <= size, peeled(cells(F.col(left), size), cells(F.col(c), size), size)).alias(n) for n, c in rights.items())
        tried = staged(todo.select(*kept, *again, *(f"{n}_size" for n in rights)), f"fingerprint-{size}")
        done.append(tried.filter(~missing).select(*kept, *rights))
        todo = tried.filter(missing)
    done.append(todo.select(*kept, *(F.coalesce(F.col(n), F.concat(F.array_except(left, c), F.array_except(c, left))).alias(n) for n, c in rights.items())))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop(number)


def _in_parts(rows: DataFrame, left: str, rights: dict[str, str], number: str) -> DataFrame:
    """``differing`` for pairs that differ much: their digests are dealt to parts of about PART each, by other bits than the
    cells use, and the parts are sketched and peeled as rows of their own. So the work is linear in a text's paragraphs."""
    rows = rows.drop(*rights)  # of a written table, so the numbers stay
    columns = (left, *rights.values())
    parts = F.greatest(F.ceil(F.greatest(*(F.array_size(c) for c in columns)) / PART), F.lit(1))

    def tag(column: str, i: int) -> Column:
        return F.transform(column, lambda d: F.struct(F.lit(i).alias("of"), d.alias("d")))

    tagged = F.flatten(F.array(*(tag(c, i) for i, c in enumerate(columns))))
    each = rows.select(number, parts.alias("__n"), F.explode(tagged).alias("x")).select(number, F.pmod(F.xxhash64("x.d"), "__n").alias("__part"), "x.of", "x.d")
    sets = each.groupBy(number, "__part").agg(*(F.collect_list(F.when(F.col("of") == i, F.col("d"))).alias(c) for i, c in enumerate(columns)))
    found = differing(staged(sets, "fingerprint-parts"), left, rights, (), f"{number}_")
    found = found.groupBy(number).agg(*(F.flatten(F.collect_list(n)).alias(n) for n in rights))
    return rows.join(found, number)


def likeness(left: Column, right: Column, difference: Column) -> Column:
    total = F.array_size(left) + F.array_size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - F.array_size(difference)) / (total + F.array_size(difference)))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, own, next_text, next_own) in ascending doc_id, own being the digests; after the last comes the first."""
    spark = docs.sparkSession
    ranges = ranges or 4 * partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    d = docs.select("doc_id", "text", key.alias("at"))
    quantiles = d.agg(F.percentile_approx("at", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), 20 * ranges)).first()[0]
    cuts = sorted(set(quantiles or []))  # at most ``ranges`` numbers
    bits = max(1, len(cuts)).bit_length()
    if cuts:
        table = F.lit(cuts).cast("array<long>")
        steps = F.array(*(F.lit(1 << b) for b in range(bits - 1, -1, -1)))
        bucket = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & (F.try_element_at(table, p + s) <= F.col("at")), p + s).otherwise(p))
    else:
        bucket = F.lit(0)
    d = d.withColumn("bucket", bucket.cast("int"))
    order = Window.orderBy("bucket")
    firsts = d.groupBy("bucket").agg(F.min("at").alias("at"))  # one row a range
    firsts = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())))
    firsts = staged(firsts.select("at", "before"), "fingerprint-ranges")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead"))
    also = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("ahead"))
    sent = d.join(F.broadcast(firsts), "at", "left").withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))))
    rows = sent.select("doc_id", "at", "text", digests(F.col("text")).alias("own"), "to.*")
    inside = Window.partitionBy("bucket").orderBy("ahead", "at", F.xxhash64("text"))
    ahead = F.lead(F.struct("text", "own")).over(inside)
    return rows.withColumn("following", ahead).filter("ahead = 0").select("doc_id", "text", "own", F.col("following.text").alias("next_text"), F.col("following.own").alias("next_own"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text, following = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))
    d = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own").alias("after"))
    d = staged(d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("changed"), "after"), "fingerprint-digests")
    d = differing(d, "own", {"d_edited": "changed", "d_next": "after"}, ("own", "changed"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", F.col("printed_own").alias("fingerprint"), F.col("printed_changed").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), F.col("d_edited")).alias("near_edited"), likeness(F.col("own"), F.col("after"), F.col("d_next")).alias("near_next"))
