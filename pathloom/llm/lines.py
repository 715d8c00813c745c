"""Line dedup, exact and fuzzy, by DataFrame operations only.

Lines are normalised to their words in lower case, parted by runs of ASCII characters that are no letters or digits. Lines of
equal normal form are one class from the start.

A class has a SimHash in blocks. Its features are the distinct words of five characters and more; forms with few of these
take their sequences of four characters (the few in between take both). A feature is dealt by its hash to one of 4 * 2**level
blocks and votes on the 40 bits of that block only, so an edit disturbs the blocks that its features are dealt to and no
others. By the pigeonhole principle, two forms that differ in fewer features than they have blocks agree in a block. The level
follows from the length, in steps of two; forms close to a step take part in both levels, so two forms whose lengths differ by
a tenth at most have a level in common. Classes meet in a join on each block on which enough features voted (three words, or
four sequences).

In a block's bucket all are compared with one central class (with up to four in large buckets); in large ones then, twice, with some
of those outside its largest group; then any two that are not in one group by now: each two of a bucket are verified or in one group, however large it is. Candidates are verified by the edit
similarity of their normal forms, and connected groups of classes keep one occurrence: the first by doc_id, then by line.

Defined results: a null text has no lines and stays null; lines without a letter or digit are kept as they are; lines of any
length take part; of rows equal in doc_id and text one keeps its lines and the others lose them; ties go to the least
(doc_id, line), null doc_ids first; an empty table gives no rows; extra columns are kept by `deduplicated` and
`without_repeated_lines`, and helper columns take names that the caller's columns leave free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_garbage, drop, free_names, stored, table
from .components import components

#: ASCII characters that are neither letters nor digits.
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Features: words of so many characters or more, or sequences of so many characters; the counts of words that are enough, or too many, for either.
LONG, GRAM, ENOUGH, MANY = 5, 4, 5, 9
#: Characters of a form for its first four blocks, with features of either kind.
WORD_UNIT, GRAM_UNIT = 180, 14
#: Votes that make a block count, of either kind; members of a bucket for each centre, and the most centres.
LEAST_WORDS, LEAST_GRAMS, FOR_CENTRE, CENTRES = 3, 4, 16, 4
#: Members of a large bucket, rounds for these before all that is left is compared, and centres of a round.
LARGE, ROUNDS, MORE_CENTRES = 64, 2, 16
#: Letters whose counts bound the edit distance of two forms from below.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Forms are similar whose lengths differ by a tenth at most.
SIMILARITY = 0.9

#: Ten lanes of six bits: each counts votes on one bit.
_LANES = sum(1 << 6 * k for k in range(10))


def normal_form(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), _OTHER + "+", " "))


def lane_votes(h: Column | str) -> list[Column]:
    """Of a 64-bit hash: four numbers of ten lanes, which hold the bits k, k + 6, ... of the hash."""
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)) for k in range(4)]


def simhash(votes: list[Column], n: Column) -> Column:
    """From the sums of lane_votes over n hashes: a bit is set where more than half of the hashes set it.

    Adding 31 - half to a lane carries a count above half into its top bit. Blocks hold ten features on average; lanes of one
    with over 31 run into each other, which is the same for equal features still.
    """
    spare = F.greatest(F.lit(31) - F.floor(n / 2), F.lit(0)).cast("long") * F.lit(_LANES)
    out = F.lit(0).cast("long")
    for k, v in enumerate(votes):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(v + spare, 5).bitwiseAND(F.lit(_LANES)), k))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (two hashes of doc_id and text), text: each distinct row with a text once, dealt by its hashes."""
    doc, text = F.col("doc_id").cast("long"), F.col("text")
    lean = docs.where("text is not null").select(doc.alias("doc_id"), *[k.alias(n) for n, k in zip(("k1", "k2"), doc_keys())], text.alias("text"))
    return lean.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("doc_id"))).where("nth = 1").drop("nth")


def doc_keys() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.col("doc_id").cast("long"), text), F.xxhash64(F.lit(1), text, F.col("doc_id").cast("long"))]


def occurrences(docs: DataFrame) -> DataFrame:
    """One row for each line with a letter or digit: k1, k2 (its document), doc_id, pos, h1, h2 and n (its normal form and the length of that) and keys (its blocks).

    Documents are dealt once; words are counted where their document lies.
    """
    lines = keyed(docs).select("doc_id", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    forms = lines.select("doc_id", "k1", "k2", "pos", normal_form(F.col("line")).alias("norm"))
    hashes = lambda pattern, group: F.array_distinct(F.transform(F.regexp_extract_all("norm", F.lit(pattern), F.lit(group)), lambda w: F.xxhash64(w)))
    ids = ["doc_id", "k1", "k2", "pos", "h1", "h2", "n"]
    words = forms.select("doc_id", "k1", "k2", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), F.length("norm").alias("n"), "norm", hashes(f"[^ ]{{{LONG},}}", 0).alias("words"))
    grams = F.when((F.size("words") <= MANY) & (F.col("n") > 0), F.when(F.col("n") < GRAM, F.array(F.xxhash64("norm"))).otherwise(hashes(f"(?s)(?=(.{{{GRAM}}}))", 1)))
    both = words.select(*ids, "words", grams.alias("grams"))
    level = lambda n, unit: F.greatest(F.floor(F.log2(n / F.lit(float(unit)))), F.lit(0)).cast("int")
    parts = []
    for kind, unit, features, there in ((0, WORD_UNIT, "words", F.size("words") >= ENOUGH), (64, GRAM_UNIT, "grams", F.col("grams").isNotNull())):
        high, low = level(F.col("n"), unit), level(F.col("n") * F.lit(SIMILARITY) - F.lit(1e-6), unit)
        part = lambda lv, k=kind, f=features: F.struct((lv + F.lit(k)).alias("tag"), F.call_function("shiftleft", F.lit(4).cast("long"), lv).alias("blocks"), F.col(f).alias("features"))
        parts += [F.when(there, part(high)), F.when(there & (low < high), part(low))]
    dealt = both.select(*ids, F.explode(F.array(*parts)).alias("p")).where("p is not null").select(*ids, "p.tag", "p.blocks", F.explode("p.features").alias("x"))
    block = F.shiftrightunsigned(F.shiftrightunsigned("x", 32) * F.col("blocks"), 32)
    votes = dealt.select(*ids, "tag", block.alias("block"), *[v.alias(f"v{k}") for k, v in enumerate(lane_votes("x"))])
    votes = votes.select(*ids, "tag", F.shiftrightunsigned("block", 2).alias("four"), F.col("block").bitwiseAND(F.lit(3).cast("long")).alias("j"), "v0", "v1", "v2", "v3")
    sums = [F.count(F.when(F.col("j") == j, 1)).alias(f"n{j}") for j in range(4)] + [F.sum(F.when(F.col("j") == j, F.col(f"v{k}")).otherwise(F.lit(0).cast("long"))).alias(f"s{j}{k}") for j in range(4) for k in range(4)]
    counted = votes.groupBy(*ids, "tag", "four").agg(*sums)
    enough = F.when(F.col("tag") < 64, LEAST_WORDS).otherwise(LEAST_GRAMS)
    keys = [F.when(F.col(f"n{j}") >= enough, F.xxhash64("tag", "four", F.lit(j), simhash([F.col(f"s{j}{k}") for k in range(4)], F.col(f"n{j}")))) for j in range(4)]
    return counted.select(*ids, F.array_compact(F.array(*keys)).alias("keys")).groupBy(*ids).agg(F.flatten(F.collect_list("keys")).alias("keys"))  # a line's own blocks


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: c, k1, k2, pos. c, the normal form of that line and how often it has each letter."""
    by_doc = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "c")).alias("places"))  # a document's own lines
    k1, k2 = doc_keys()
    lines = docs.where("text is not null").select(k1.alias("k1"), k2.alias("k2"), F.col("text")).join(by_doc, ["k1", "k2"]).select(F.split("text", "\n").alias("lines"), "places")
    forms = lines.select("lines", F.explode("places").alias("p")).select(F.col("p.c").alias("c"), normal_form(F.element_at("lines", F.col("p.pos") + 1)).alias("norm"))
    letters = F.array(*[(F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(x)))).cast("int") for x in LETTERS])
    return forms.dropDuplicates(["c"]).withColumn("letters", letters)  # repeated rows


def _check(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose edit distance is small enough for their length.

    An edit takes away one letter at most and adds one at most, so letters that one has more of than the other bound the distance
    from below. Words that both begin with and words that both end with don't count in the distance, so only what lies between is measured.
    If as many words lie there in both, changing each differing word as a whole bounds the distance, which settles most pairs.
    """
    side = lambda x: texts.select(F.col("c").alias(x), F.col("norm").alias(f"n{x}"), F.col("letters").alias(f"l{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.greatest(F.length("na"), F.length("nb"))
    both = both.withColumn("allowed", F.floor(most * F.lit(1 - similarity) + 1e-9).cast("int")).where("abs(length(na) - length(nb)) <= allowed")
    more = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.greatest(p - q, F.lit(0))), F.lit(0), lambda t, p: t + p)
    both = both.where((more("la", "lb") <= F.col("allowed")) & (more("lb", "la") <= F.col("allowed")))
    split = both.select("a", "b", "allowed", F.split("na", " ").alias("wa"), F.split("nb", " ").alias("wb"))
    differ = lambda x, y: ~x.eqNullSafe(y)
    ahead = F.array_position(F.zip_with("wa", "wb", differ), True) - 1
    behind = F.array_position(F.zip_with(F.reverse("wa"), F.reverse("wb"), differ), True) - 1
    least = F.least(F.size("wa"), F.size("wb"))
    same = split.withColumn("ahead", ahead.cast("int")).withColumn("behind", F.least(behind.cast("int"), least - F.col("ahead")))
    middle = lambda w: F.slice(w, F.col("ahead") + 1, F.size(w) - F.col("ahead") - F.col("behind"))
    inner = same.select("a", "b", "allowed", middle("wa").alias("ma"), middle("wb").alias("mb"))
    swap = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y)))), F.lit(0), lambda t, x: t + x)
    # The cost of measuring grows with the distance that is allowed; most near forms are much nearer than that.
    joined = inner.withColumn("quick", (F.size("ma") == F.size("mb")) & (swap <= F.col("allowed"))).select("a", "b", "allowed", "quick", F.array_join("ma", " ").alias("xa"), F.array_join("mb", " ").alias("xb"))
    measured = F.expr("levenshtein(xa, xb, cast(allowed / 3 as int)) >= 0 or levenshtein(xa, xb, allowed) >= 0")
    return joined.where(F.col("quick") | measured).select("a", "b")


def open_buckets(met: DataFrame, group: DataFrame) -> DataFrame:
    """met: key, c, n (length), members; group: c, g. The members of buckets that hold several groups: key, c, n, members, g, main (the largest group) and rest (members outside it)."""
    members = met.join(group, "c", "left").select("key", "c", "n", "members", F.coalesce("g", "c").alias("g"))
    sizes = members.groupBy("key", "g").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "g")).alias("m"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return members.join(main.select("key", F.col("m.g").alias("main"), (F.col("all") - F.col("m.size")).alias("rest")), "key")


def without(members: DataFrame, centres: DataFrame) -> DataFrame:
    return members.join(centres.withColumnRenamed("centre", "c"), ["key", "c"], "left_anti")


def _alike(similarity: float):
    return F.abs(F.col("n") - F.col("o")) <= F.greatest("n", "o") * F.lit(1 - similarity) + F.lit(1e-9)


def centre_pairs(members: DataFrame, fresh: DataFrame, centres: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of fresh centres (key, centre) and all others of the key's bucket in other groups, of like length, but for centres before."""
    ahead = members.join(fresh.withColumnRenamed("centre", "c"), ["key", "c"]).select("key", F.col("c").alias("e"), F.col("n").alias("o"), F.col("g").alias("h"))
    found = without(members, centres).join(ahead, "key").where((F.col("g") != F.col("h")) & _alike(similarity))
    return found.select(F.least("c", "e").alias("a"), F.greatest("c", "e").alias("b")).distinct()


def unsettled_pairs(members: DataFrame, centres: DataFrame, similarity: float, salt: int = 256) -> DataFrame:
    """members: of open buckets; centres: key, centre. The pairs (a, b) that share a key, are in different groups and of like length, but for those with a centre.

    In each key's bucket, all meet those outside its largest group, whose members don't meet each other. The others are dealt
    over salts, for which the members are repeated.
    """
    members = stored(without(members, centres).withColumn("salts", F.ceil(F.col("rest") / salt).cast("long")), "unsettled-lines")
    others = members.where("g <> main").select("key", F.pmod(F.xxhash64("c"), "salts").alias("salt"), F.col("c").alias("e"), F.col("n").alias("o"), F.col("g").alias("h"))
    dealt = members.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    once = (F.col("g") == F.col("main")) | (F.col("c") < F.col("e"))
    found = dealt.join(others, ["key", "salt"]).where((F.col("g") != F.col("h")) & once & _alike(similarity))
    return found.select(F.least("c", "e").alias("a"), F.greatest("c", "e").alias("b")).distinct()


def groups(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """classes: c, size (length), first (k1, k2, doc_id, pos), keys. c and group (least c) of the classes that fuzzy links join to others."""
    blocks = classes.select("c", F.col("size").alias("n"), F.explode("keys").alias("key"))
    buckets = stored(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("c").alias("first"), F.max("c").alias("last")).where("first < last"), "line-buckets")
    met = stored(blocks.join(buckets.where("members > 2").select("key", "members"), "key"), "line-members")
    order = Window.partitionBy("key").orderBy(F.xxhash64("c"), "c")
    centres = met.withColumn("at", F.row_number().over(order)).where((F.col("at") <= CENTRES) & (F.col("at") <= F.greatest(F.lit(1), F.col("members") / FOR_CENTRE))).select("key", F.col("c").alias("centre"))
    centres = stored(centres, "line-centres")
    stars = met.join(centres, "key").where("c <> centre").select(F.least("centre", "c").alias("a"), F.greatest("centre", "c").alias("b"))
    pairs = stored(buckets.where("members = 2").select(F.col("first").alias("a"), F.col("last").alias("b")).union(stars).distinct(), "line-pairs")

    # The first pairs hold every class that shares a block with another, so these texts do for all rounds.
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct().join(classes, "c")
    texts = stored(_texts(docs, wanted.select("c", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), F.col("first.pos").alias("pos"))), "line-texts")
    collect_garbage(docs.sparkSession)

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        links = stored(_check(pairs, texts, similarity), name)
        drop(pairs)
        collect_garbage(docs.sparkSession)
        return links

    def grown(group: DataFrame | None, links: DataFrame) -> DataFrame:
        edges = links if group is None else group.where("c <> g").select(F.col("c").alias("a"), F.col("g").alias("b")).union(links)
        out = stored(components(edges).select(F.col("node").alias("c"), F.col("component").alias("g")), "line-groups")
        drop(links, *[group] * (group is not None))
        return out

    group = grown(None, checked(pairs, "line-links"))
    for _ in range(ROUNDS):
        large = stored(open_buckets(met.where(F.col("members") > LARGE), group), "open-buckets")
        fresh = without(large.where("g <> main"), centres).withColumn("at", F.row_number().over(order)).where(F.col("at") <= MORE_CENTRES).select("key", F.col("c").alias("centre"))
        fresh = stored(fresh, "line-centres")
        if fresh.isEmpty():
            break
        group = grown(group, checked(stored(centre_pairs(large, fresh, centres, similarity), "line-pairs"), "line-links"))
        centres = stored(centres.union(fresh), "line-centres")
    rest = stored(unsettled_pairs(open_buckets(met, group), centres, similarity), "line-rest")
    if not rest.isEmpty():
        more = checked(rest, "more-line-links")
        if not more.isEmpty():
            group = grown(group, more)
    drop(texts, buckets, met)
    return group.select("c", F.col("g").alias("group"))


def repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """k1, k2 and gone (positions) of the documents that hold lines of which another occurrence is kept."""
    rows = stored(occurrences(docs), "lines")
    place = F.struct("doc_id", "k1", "k2", "pos")
    classes = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.any_value("n").alias("size"), F.any_value("keys").alias("keys"))
    # Classes are numbered in the stored table; nothing but the order of comparisons hangs on the numbers.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("c"), "h1", "h2", "n", "size", "first", "keys"), "line-classes")
    places = stored(rows.select("h1", "h2", "k1", "k2", "pos"), "line-places")  # the keys are most of the table
    drop(rows)
    collect_garbage(docs.sparkSession)
    joined = classes.drop("keys").join(groups(docs, classes, similarity), "c", "left").where("n > 1 or group is not null").select("h1", "h2", "first", F.coalesce("group", "c").alias("group"))
    joined = stored(joined, "line-repeats")
    best = joined.groupBy("group").agg(F.min("first").alias("best"))
    repeated = joined.join(best, "group").select("h1", "h2", F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2"), F.col("best.pos").alias("bp"))
    gone = places.join(repeated, ["h1", "h2"]).where("k1 <> b1 or k2 <> b2 or pos <> bp")
    return gone.groupBy("k1", "k2").agg(F.collect_list("pos").alias("gone"))  # a document's own lines


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, n_lines: str = "_n_lines", n_dropped: str = "_n_dropped") -> DataFrame:
    """docs with their columns, text without the repeated lines, and two columns more: the lines there were, and those dropped.

    Where docs has a column of either name already, the new one's name gets underscores added.
    """
    if not docs.columns:
        raise ValueError("documents have columns")
    n_lines, n_dropped, c1, c2, gone, nth, again, split = free_names(docs, n_lines, n_dropped, "_k1", "_k2", "_gone", "_nth", "_again", "_split")
    k1, k2 = doc_keys()
    marked = docs.withColumns({c1: k1, c2: k2})
    flags = repeats(docs, similarity).select(F.col("k1").alias(c1), F.col("k2").alias(c2), F.col("gone").alias(gone))
    twice = marked.where("text is not null").groupBy(c1, c2).agg(F.count(F.lit(1)).alias(again)).where(F.col(again) > 1).select(c1, c2)
    twice = stored(twice, "repeated-rows")
    if twice.isEmpty():
        marked = marked.withColumn(nth, F.lit(1))
    else:
        among = Window.partitionBy(c1, c2).orderBy(c1)
        marked = marked.join(twice, [c1, c2], "left_anti").withColumn(nth, F.lit(1)).unionByName(marked.join(twice, [c1, c2], "left_semi").withColumn(nth, F.row_number().over(among)))
    joined = marked.join(flags, [c1, c2], "left").withColumn(split, F.split("text", "\n"))
    lines = F.col(split)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.element_at(lines, i + 1))
    real = lambda xs: F.filter(xs, lambda x: normal_form(x) == "")
    text = F.when(F.col(nth) > 1, F.array_join(real(lines), "\n")).when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(nth) > 1, F.size(lines) - F.size(real(lines))).otherwise(F.coalesce(F.size(gone), F.lit(0)))
    whole = F.coalesce(F.size(lines), F.lit(0))
    return joined.select(*[text.alias(n) if n == "text" else F.col(f"`{n}`") for n in docs.columns], whole.cast("long").alias(n_lines), dropped.cast("long").alias(n_dropped))


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with their columns; documents of which nothing but empty lines is left, and that had more, go. n_chars follows the text."""
    n_lines, n_dropped = free_names(docs, "_n_lines", "_n_dropped")
    out = deduplicated(docs, similarity, n_lines, n_dropped)
    out = out.where((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{n}`") for n in docs.columns])


def op3_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), n_lines="n_lines", n_dropped="n_dropped")
