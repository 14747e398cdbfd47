"""Document fingerprints as invertible Bloom lookup sketches; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.common import Scratch

TABLES = 3  # every digest lies in one cell of each
BITS = 3  # cells of a table of the printed sketch, as a power of two
CHECK, ADDRESS = 7, 11  # seeds of a digest's check value and of its addresses
ROUNDS = 15  # peeling rounds, of one table after the other, before a sketch counts as failed
DEALT = 200_000  # digests in a task
#: A paragraph ends with its line and with every sentence, in any script; stops that no space follows are cut after.
LINE_OR_SPACE_END = r"\n| (?<=[.!?\u2026\u037E\u0589\u061F\u06D4\u0964\u0965\u1362][\"'\u201D\u2019\u00BB)\]]? )"
PARAGRAPH_END = LINE_OR_SPACE_END + r"|(?<=[\u3002\uFF01\uFF1F\uFF61])(?![\u3002\uFF01\uFF1F\uFF61\u300D\u300F\uFF09\u201D\u2019])"
WIDE_STOPS = "\u3002\uFF01\uFF1F\uFF61"  # those that are cut after; without one only lines and spaces can be ends
#: A text's first sentence and sentences of more signs are cut further: behind one word in eight, or in words of over
#: LONG_WORD signs behind one sign in sixteen. The hash of the word, or of the sign and the two next, says where.
LONG_SENTENCE, LONG_WORD, WORDS, SIGNS = 256, 32, 8, 16

_CELL = "struct<cell:bigint,cnt:bigint,key:bigint,chk:bigint>"


def _sentence_parts(sentence: Column) -> Column:
    """A sentence cut where its content says, so that what is put in before or behind a part leaves it as it is."""

    def marked(piece: Column, digest: Column, every: int) -> Column:
        return F.when(digest.bitwiseAND(every - 1) == 0, F.concat(piece, F.lit("\n"))).otherwise(piece)

    def signs(word: Column) -> Column:
        each, n = F.split(word, ""), F.length(word)
        next_two = F.zip_with(F.slice(each, 2, n), F.slice(each, 3, n), lambda d, e: F.concat(d, F.coalesce(e, F.lit(""))))
        return F.array_join(F.zip_with(each, next_two, lambda c, de: marked(c, F.xxhash64(c, de), SIGNS)), "")

    def word_or_signs(word: Column) -> Column:
        return F.when(F.length(word) > LONG_WORD, signs(word)).otherwise(marked(word, F.xxhash64(word), WORDS))

    return F.split(F.array_join(F.transform(F.split(sentence, " "), word_or_signs), " "), "\n")


def paragraph_digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs; null and empty texts have none."""
    whole = F.coalesce(text, F.lit(""))
    wide = reduce(Column.__or__, [F.contains(whole, F.lit(stop)) for stop in WIDE_STOPS])
    sentences = F.when(wide, F.split(whole, PARAGRAPH_END)).otherwise(F.split(whole, LINE_OR_SPACE_END))
    long = lambda s, i: (i == 0) | (F.length(s) > LONG_SENTENCE)
    parts = F.transform(sentences, lambda s, i: F.when(long(s, i), _sentence_parts(s)).otherwise(F.array(s)))
    pieces = F.filter(F.flatten(parts), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _address(digest: Column, table: int, bits: Column | int) -> Column:
    """A digest's cell in one table of 2^bits cells; fewer bits fold a larger sketch onto a smaller one."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits) if isinstance(bits, int) else bits)
    return size * table + F.xxhash64(F.lit(ADDRESS + table), digest).bitwiseAND(size - 1)


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit(CHECK), digest)


def sketch_strings(dealt: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, a string for each column): the sketch of 3 x 8 cells in base 64 of each column of digests.

    Of each cell the count, the keys' and the checks' exclusive-or. Rows must be dealt by the key, which is
    unique: then nothing is shuffled.
    """
    sides = [F.struct(F.lit(i).alias("side"), F.col(c).alias("keys")) for i, c in enumerate(columns)]
    rows = dealt.select(key, F.explode(F.array(*sides)).alias("s")).select(key, "s.side", F.explode("s.keys").alias("key"))
    address = F.array(*[_address(F.col("key"), t, BITS) for t in range(TABLES)])
    rows = rows.select(key, "side", "key", _check(F.col("key")).alias("chk"), F.explode(address).alias("cell"))
    cells = rows.groupBy(key, "side", "cell").agg(
        F.count(F.lit(1)).alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")
    )
    digits = lambda c, n: F.lpad(F.hex(c), n, "0")
    shown = F.concat(digits("cnt", 8), digits("key", 16), F.substring(digits("chk", 16), 9, 8))
    place = F.col("side") * (TABLES << BITS) + F.col("cell").cast("int")
    maps = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("at"), shown.alias("hex")))).alias("m"))
    maps = dealt.select(key).join(maps, key, "left")

    def text(side: int) -> Column:
        places = F.sequence(F.lit(side * (TABLES << BITS)), F.lit((side + 1) * (TABLES << BITS) - 1))
        found = F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit("0" * 32)))
        return F.translate(F.base64(F.unhex(F.array_join(found, ""))), "\r\n", "")

    return maps.select(key, *[text(i).alias(name) for i, name in enumerate(columns.values())])


def _next_ids(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, next_id) of distinct ids in ascending order, null first; the last one's next is the first."""
    order = [F.col("doc_id").asc_nulls_first()]
    ranged = scratch.keep(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("id"))
    firsts = ranged.groupBy("part").agg(F.min(own).alias("first"))  # a row for each range partition
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(whole))
    firsts = firsts.select("part", follows.alias("follows"))
    inside = F.lead(own).over(Window.partitionBy("part").orderBy(*order))
    chained = ranged.join(F.broadcast(firsts), "part").withColumn("next", F.coalesce(inside, "follows"))
    return chained.select("doc_id", "n_chars", F.col("next.id").alias("next_id"))


def edited_documents(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(some, id, first, text, edited, next_some, next_id): each text, and with its second half replaced.

    The last floor(n_chars / 2) code points give way to the first as many (or all) of the next document in
    ascending doc_id, null first; after the last comes the first. Rows that repeat a doc_id all have the next
    larger id; of several rows there the smallest text, the first, is taken. Only the part of a text that its
    neighbour needs is sent to it. some says whether a doc_id is not null, id is 0 where it is.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    ids = rows.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    chain = scratch.keep(_next_ids(ids, scratch))
    # Plain equal keys that stand for a null id too, and no other column beside the text: both joins and the
    # window then share one shuffle of the texts.
    key = lambda c: (F.col(c).isNotNull(), F.coalesce(c, F.lit(0)))
    rows = rows.select(*[k.alias(a) for k, a in zip(key("doc_id"), ("some", "id"))], "text")
    needs = chain.select(
        *[k.alias(a) for k, a in zip(key("next_id"), ("some", "id"))],
        *[k.alias(a) for k, a in zip(key("doc_id"), ("to_some", "to_id"))],
        F.floor(F.col("n_chars") / 2).cast("int").alias("most"),
    )
    # Ties by text; several documents never have the same next one.
    smallest = F.row_number().over(Window.partitionBy("some", "id").orderBy("text"))
    # The join comes first: a limit below the shuffle of the texts would make it another one.
    giving = rows.join(needs, ["some", "id"]).withColumn("place", smallest).where("place = 1")
    rows = rows.withColumn("first", smallest == 1)
    given = giving.select(
        F.col("to_some").alias("some"), F.col("to_id").alias("id"),
        F.substring("text", F.lit(1), F.col("most")).alias("head"),
        F.col("some").alias("next_some"), F.col("id").alias("next_id"),
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("head", F.lit(1), half)).alias("edited")
    return rows.join(given, ["some", "id"]).select("some", "id", "first", "text", edited, "next_some", "next_id")


def _peeled(cells: DataFrame, keys: list[str], table: int) -> DataFrame:
    """One peeling round over the difference cells (cell >= 0) of a table; digests found are counted in cells -1, -2.

    A cell that holds one digest gives it away: it is taken out of its cells in the other tables. A digest lies in
    one cell of a table, so none is taken out twice. Cell -1 counts the digests that mine has more, cell -2 those
    that it lacks, so that the next rounds need not carry them.
    """
    key, cnt = F.col("key"), F.col("cnt")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    here = (F.col("cell") >= size * table) & (F.col("cell") < size * (table + 1))
    alone = here & (F.abs(cnt) == 1) & (F.col("chk") == _check(key))

    def row(cell: Column, count: Column, key: Column, chk: Column) -> Column:
        return F.struct(cell.alias("cell"), count.alias("cnt"), key.alias("key"), chk.alias("chk")).cast(_CELL)

    none = F.lit(0).cast("long")
    others = [row(_address(key, t, F.col("bits")), -cnt, key, F.col("chk")) for t in range(TABLES) if t != table]
    found = row(F.when(cnt > 0, -1).otherwise(-2).cast("long"), F.lit(1).cast("long"), none, none)
    made = F.when(alone, F.array(*others, found)).otherwise(F.array(row(F.col("cell"), cnt, key, F.col("chk"))))
    out = cells.select(*keys, F.explode(made).alias("x")).select(*keys, "x.*")
    out = out.groupBy(*keys, "cell").agg(
        F.sum("cnt").alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")
    )
    return out.where("NOT (cell >= 0 AND cnt = 0 AND key = 0 AND chk = 0)")


def sketch_differences(pairs: DataFrame, names: tuple[str, ...] = ("pair",)) -> DataFrame:
    """(names, extra, lacks, left) for pairs (names, bits, mine array, theirs array).

    Both sides go into sketches of 3 x 2^bits cells, which are subtracted cell by cell; peeling then recovers
    the digests that mine has more (extra) and less (lacks). left counts cells that no round could empty.
    Rows must be dealt by some of the names, the key of a pair: then every step finds all rows of a pair in
    its task and shuffles nothing.
    """
    sides = F.concat(
        F.transform("mine", lambda d: F.struct(d.alias("key"), F.lit(1).cast("long").alias("cnt"))),
        F.transform("theirs", lambda d: F.struct(d.alias("key"), F.lit(-1).cast("long").alias("cnt"))),
    )
    keys = [*names, "bits"]
    entries = pairs.select(*keys, F.explode(sides).alias("e")).select(*keys, "e.*")
    entries = entries.withColumn("chk", _check(F.col("key")))
    address = F.array(*[_address(F.col("key"), t, F.col("bits")) for t in range(TABLES)])
    cells = entries.select(*keys, F.explode(address).alias("cell"), "key", "cnt", "chk")
    cells = cells.groupBy(*keys, "cell").agg(
        F.sum("cnt").alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")
    )
    cells = cells.where("cnt != 0 OR key != 0 OR chk != 0")
    cells = reduce(lambda c, i: _peeled(c, keys, i % TABLES), range(ROUNDS), cells)
    some = lambda c: F.count(F.when(c, 1))
    of = lambda n: F.coalesce(F.sum(F.when(F.col("cell") == n, F.col("cnt"))), F.lit(0))
    return cells.groupBy(*names).agg(
        of(-1).alias("extra"),
        of(-2).alias("lacks"),
        some(F.col("cell") >= 0).alias("left"),
    )


def recovered_differences(
    pairs: DataFrame,
    scratch: Scratch,
    names: tuple[str, ...] = ("pair",),
    pairs_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(names, extra, lacks) for all pairs (names, mine, theirs) that differ; sketches that fail are made larger.

    The first sketch has 1.5 to 3 cells for each digest of the two sides, and each retry four times the
    cells of the last. Pairs come dealt by the first of the names; those whose sketch failed are taken by
    pairs_of, from where they are stored, so that the others are not shuffled again, and dealt anew.
    """
    total = F.size("mine") + F.size("theirs")
    bits = F.greatest(F.lit(BITS), F.ceil(F.log2(total / 2 + 1)).cast("int"))
    chosen = lambda rows: lambda failed: rows.join(failed, list(names), "left_semi")
    left, pairs_of, done, more = pairs.withColumn("bits", bits), pairs_of or chosen(pairs), None, 0
    while True:
        tried = scratch.keep(sketch_differences(left, names))
        good = tried.where("left = 0").select(*names, "extra", "lacks")
        done = good if done is None else done.unionByName(good)
        failed = scratch.keep_small(tried.where("left > 0").select(*names))
        if failed.isEmpty():
            return done
        more += 2
        rows = scratch.keep(pairs_of(failed).withColumn("bits", bits + more))
        left, pairs_of = dealt_out(rows, names[0], total), chosen(rows)


def dealt_out(rows: DataFrame, key: str, digests: Column) -> DataFrame:
    """The rows hashed by the key over tasks of about DEALT digests."""
    n = rows.agg(F.sum(digests)).first()[0] or 0
    return rows.repartition(max(1, -(-n // DEALT)), key)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A fingerprint is the sketch of a text's distinct paragraphs. Likeness is what two texts share of all
    paragraphs either has, found from the digests that peeling recovers from the subtracted sketches; 1 when
    neither has any. Equal texts have equal fingerprints and likeness 1. Null texts are empty; null doc_ids
    come first in order; repeated rows are returned as often as they come. A table of one row is its own
    next document. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    both = edited_documents(docs, scratch, id_col, text_col)
    base = both.select(
        F.when(F.col("some"), F.col("id")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"),
        paragraph_digests(F.col("edited")).alias("edited"),
        *["some", "id", "first", "next_some", "next_id"],
    )
    own = scratch.keep(base.withColumn("row", F.monotonically_increasing_id()))
    scratch.release()  # the shuffles of the texts
    # A text's digests are made once; the document before it gets them from here.
    following = own.where("first").select(
        F.col("some").alias("next_some"), F.col("id").alias("next_id"), F.col("own").alias("following")
    )
    base = scratch.keep(own.drop("some", "id", "first").join(following, ["next_some", "next_id"]).drop("next_some", "next_id"))
    scratch.drop(own)
    scratch.release()
    dealt = dealt_out(base, "row", 3 * F.size("own") + F.size("edited") + F.size("following"))
    against = [F.struct(F.lit(k).alias("k"), F.col(c).alias("theirs")) for k, c in enumerate(("edited", "following"))]

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select("row", F.col("own").alias("mine"), F.explode(F.array(*against)).alias("a")).select("row", "mine", "a.*")

    def pairs_of(failed: DataFrame) -> DataFrame:
        # Rows are chosen before they become two pairs each, and as they are stored.
        return pairs(base.join(failed, "row", "left_semi")).join(failed, ["row", "k"], "left_semi")

    found = recovered_differences(pairs(dealt), scratch, ("row", "k"), pairs_of)
    scratch.release()  # the shuffles of the digests
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    found = found.groupBy("row").agg(*[of(k, c) for k in (0, 1) for c in ("extra", "lacks")])
    prints = sketch_strings(dealt, "row", {"own": "fingerprint", "edited": "edited_fingerprint"})

    def likeness(k: int) -> Column:
        extra, lacks = (F.coalesce(f"{c}{k}", F.lit(0)) for c in ("extra", "lacks"))
        either = F.col("n_own") + lacks
        return F.when(either == 0, 1.0).otherwise((F.col("n_own") - extra) / either)

    scalars = dealt.select("row", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("n_own"))
    return scalars.join(found, "row", "left").join(prints, "row").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(0).alias("near_edited"),
        likeness(1).alias("near_next"),
    )
