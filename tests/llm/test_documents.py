"""Operators on documents: odd cases, and small fixtures against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import lines, mixing, neardup, packing, planes, quality, wordpiece
from pathloom.llm.common import numbered, scratch
from pathloom.llm.components import components
from pathloom.llm.encode import Encoder, vocabulary_path
from pathloom.llm.shingles import Shingler, WeightedSampler, weighted_jaccard


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def prose(spark):
    """Documents with shared, near and long lines."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = line(60)
    docs = []
    for i in range(80):
        text = [line(rng.randint(5, 80)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            text.append(common)
        if i % 7 == 0:
            text.append(common.replace(common.split()[3], "other").upper() + ".")
        docs.append((i, "\n".join(text), "en", f"s{i % 4}", 0))
    base = docs[3][1].replace("\n", " ") + " " + line(300)
    for k in range(12):
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "edited"
        docs.append((100 + k, " ".join(w), "en", "s9", 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")


# Token ids
def test_encoder_equals_library(library):
    rng = random.Random(2)
    parts = ["  ", "\n", " ", "\t", " a", "é", "'s", "\u2003", "x", "1", "<|endoftext|>", "\r\n", "日本", "!", "  b", "\x85", "\x1c", "œ", "foo", "'ll", "$$", ".\nBar", "\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", " ", "\n"]
    e = Encoder(vocabulary_path(), entries=100)
    assert [x.tolist() for x in e.encode_column(pa.array(texts))] == [library(t) for t in texts]
    assert [x.tolist() for x in e.encode_column(pa.array(["z", *texts]).slice(1))] == [library(t) for t in texts]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["byte", "bit"]))
@settings(max_examples=50, deadline=None)
def test_planes_round_trip(ids, by):
    ids = np.array(ids, dtype="<u4")
    kept = [p if any(p) else b"" for p in planes.shuffle(ids, by)]
    assert (planes.unshuffle(kept, len(ids), by) == ids).all()


@pytest.mark.parametrize("by", ["byte", "bit"])
def test_op2(spark, odd_docs, library, by):
    manifest = planes.write_planes(odd_docs, scratch(spark, "t"), by=by, block=50)
    found = [tuple(r) for r in planes.read_planes(manifest).collect()]
    rows = [(d, t) for d, t in odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("t"), "t").collect()]
    wanted, start = [], 0
    for d, t in rows:
        ids = np.array([*library(t), 0], dtype="<u4")
        wanted.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == wanted


def test_op2_empty(spark, no_docs):
    assert planes.read_planes(planes.write_planes(no_docs, scratch(spark, "t"))).count() == 0


def _packed(rows, library, texts, window):
    by_doc = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and all(r.padded == (at if at & (at - 1) == 0 and at < window else window) for r in pieces)
    for d, t in texts:
        ids = np.array([*library(t or ""), 0], dtype="<u4")
        copies = sum(1 for e, _ in texts if e == d)
        assert sum(r.length for r in by_doc[d]) == copies * len(ids)
        for r in by_doc[d]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return sequences


def test_op7(spark, odd_docs, prose, library):
    for docs, window in ((odd_docs, 64), (prose, 128)):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        rows = packing.pack(docs, window=window).collect()
        sequences = _packed(rows, library, texts, window)
        total = sum(r.length for r in rows)
        assert len(sequences) == -(-total // window)
    assert packing.pack(docs.where("false"), window=64).count() == 0


def test_packing_plan_uses_no_more_than_there_is():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 128)
    h[0], h[90] = 0, 3000
    made, left = packing.plan(h, 128, 3)
    fill = collections.Counter()
    for length, low, high, first, _ in made.runs:
        for k in range(high - low):
            fill[first + k] += length
    assert set(fill.values()) == {128} and len(fill) == made.sequences and made.sequences > 0
    taken = collections.Counter()
    for length, low, high, _, _ in sorted(made.runs):
        assert low == taken[length]
        taken[length] = high
    assert all(taken[k] + left[k] == h[k] for k in range(128)) and made.solved + made.greedy == sum(taken.values())


def test_packing_places_most_pieces_by_the_solved_combinations(library):
    texts = pa.parquet.read_table(f"{DATA.replace('sf0.001', 'sf0.1').replace('sf0.01', 'sf0.1')}/documents.parquet", columns=["text"]).column(0).combine_chunks().fill_null("")
    h = np.bincount([(len(x) + 1) % 1024 for x in Encoder(vocabulary_path()).encode_column(texts)], minlength=1024)
    h[0] = 0
    made, left = packing.plan(h)
    assert made.solved >= 0.8 * h.sum() and made.solved + made.greedy + left.sum() == h.sum()


def test_greedy_packing_completes_windows_exactly():
    h = np.zeros(64, dtype=np.int64)
    h[[40, 10, 9, 5, 63]] = [7, 7, 7, 7, 3]
    made, left = packing.plan(h, 64, 2)
    assert made.solved == 0 and made.greedy == 28 and left.sum() == 3


# Words
def test_op8(spark, odd_docs, no_docs):
    import public_tokenizers

    pieces = set(wordpiece.rank_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken")))

    def brute(word):
        n = 0
        while word:
            k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
            if not k:
                return 1
            word, n = word[k:], n + 1
        return n

    found = sorted(map(tuple, wordpiece.token_counts(odd_docs).collect()), key=repr)
    wanted = []
    for d, t in odd_docs.select("doc_id", "text").collect():
        data = (t or "").encode()
        words = data.split()
        counts = collections.Counter(words)
        wanted.append((d, len(data), len(words), sum(n * brute(b" " + w) for w, n in counts.items())))
    assert found == sorted(wanted, key=repr)
    assert wordpiece.token_counts(no_docs).count() == 0


def test_automaton_equals_greedy_matching():
    rng = random.Random(4)
    for _ in range(200):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        a = wordpiece.Automaton(pieces)
        for _ in range(40):
            word = rest = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            n = 0
            while rest:
                k = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
                if not k:
                    n = 1
                    break
                rest, n = rest[k:], n + 1
            assert a.count(word) == n


# Rules
def _measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(seen) - len(set(seen)), len(covered)


@given(st.text(alphabet="ab #\n\x0b\x85\u2003é", max_size=120))
@settings(max_examples=300, deadline=None)
def test_measures(text):
    assert quality.measures(text) == _measures(text)


def test_op6(odd_docs, no_docs):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id in (3, 5, 7):
            assert r.n_words == 0 and r.base_failed and not r.kept
        if r.doc_id == 9:
            assert r.n_dup_lines == 1 and r.n_repeat_words == 22 and r.base_failed
    kept = quality.accepted(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(map(repr, [r.doc_id for r in kept.collect()])) == sorted(repr(r.doc_id) for r in rows if r.kept)
    assert quality.judge(no_docs).count() == 0 and quality.accepted(no_docs).count() == 0


def test_a_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{k}" for k in range(30)), "same words here again now " * 20
    rows = [(i, bad if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good, f"h{i % 20}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept == {1000 + i for i in range(400)}


# Mixing
def test_op10(odd_docs, no_docs, prose):
    for docs in (odd_docs, prose):
        rows = mixing.mix(docs).collect()
        again = mixing.mix(docs.repartition(3)).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == docs.count()
        assert all(r.taken <= 3 * r.size for r in rows)
        groups = collections.defaultdict(list)
        for r in rows:
            groups[(r.source_size, r.target)].append(r)
        for (size, target), own in groups.items():
            n_sources = sum(r.size for r in own) / size if size else 1
            assert abs(sum(r.taken for r in own) - n_sources * target) <= n_sources * max(r.size for r in own) + 1e-6
        assert sum(r.size for r in rows) == pytest.approx(sum({(r.source_size, r.target): r.target * (sum(x.size for x in groups[(r.source_size, r.target)]) / max(1, r.source_size)) for r in rows}.values()))
        taken = collections.Counter()
        for r in rows:
            taken[r.doc_id] += r.copies
        copies = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
        assert {k: v for k, v in taken.items() if v} == dict(copies)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_multipliers_solve_the_dual(spark):
    """Against a search by halving; documents of one source are tilted by their size."""
    rng = random.Random(5)
    sizes, sources = [], []
    for k, ratio in enumerate((1e-6, 0.01, 0.5, 1.0, 1.7, 2.9, 2.9999, 3.0, 0.0)):
        own = collections.Counter(int(rng.expovariate(0.02)) for _ in range(300)) | collections.Counter({30_000: 1})
        total = sum(s * n for s, n in own.items())
        sizes += [(k, s, n) for s, n in own.items()]
        sources.append((k, total / sum(own.values()), total * ratio, total))
    got = {r.source_no: r.x for r in mixing.multipliers(spark.createDataFrame(sizes, "source_no long, size long, n long"), spark.createDataFrame(sources, "source_no long, mean double, target double, source_size long")).collect()}
    for k, mean, target, total in sources:
        if not 0 < target < 3 * total:
            assert got[k] is None
            continue
        words = lambda x, k=k, mean=mean: sum(n * s * min(3.0, np.exp(min(4.0, x * s / mean))) for j, s, n in sizes if j == k)
        low, high = -1e5, 1e5
        for _ in range(200):
            low, high = ((low + high) / 2, high) if words((low + high) / 2) < target else (low, (low + high) / 2)
        assert words(got[k]) == pytest.approx(target, rel=1e-9, abs=1e-8) and got[k] == pytest.approx(low, rel=1e-6, abs=1e-9)


def test_mixed_deals_copies_to_equal_rows_in_turn(spark):
    text = "w " * 40
    docs = spark.createDataFrame([(1, text, "a", i) for i in range(5)] + [(2, "x " * 300, "b", 9), (3, None, None, 1)], "doc_id long, text string, source string, _k1 long")
    times = collections.Counter((r.doc_id, r._k1) for r in mixing.mixed(docs).collect())
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.copies
    own = [times[(1, i)] for i in range(5)]
    assert sum(own) == taken[1] and max(own) - min(own) <= 1 and times[(2, 9)] == taken[2]


# Lines
def _simhash(hashes):
    bits = [6 * lane + k for lane in range(10) for k in range(4)]
    return sum(1 << b for b in bits if sum(h >> b & 1 for h in hashes) > len(hashes) // 2)


def test_simhash(spark):
    rng = random.Random(6)
    sets = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 10, 31)] + [[-1] * 31, [0, -1], [-1, -1, 0]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "i long, h array<long>").select("i", F.explode("h").alias("h"))
    sums = df.groupBy("i").agg(F.count("h").alias("n"), *[F.sum(v).alias(f"s{k}") for k, v in enumerate(lines.lane_votes("h"))])
    assert [r.s for r in sums.orderBy("i").select(lines.simhash([F.col(f"s{k}") for k in range(4)], F.col("n")).alias("s")).collect()] == [_simhash(x) for x in sets]


def test_edit_check_is_exact(spark):
    """Stripping ends and bounding by words changes no verdict."""
    rng = random.Random(9)
    words = ["aa", "ab", "b", "cde", "cdf"]
    pairs, texts = [], {}
    for i in range(300):
        a = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.choice(words)] if rng.random() < 0.7 else []
        texts[2 * i], texts[2 * i + 1] = " ".join(a), " ".join(b)
        if a != b and b:
            pairs.append((2 * i, 2 * i + 1))
    forms = spark.createDataFrame([(c, t, [t.count(x) for x in lines.LETTERS]) for c, t in texts.items()], "c long, norm string, letters array<int>")
    found = {tuple(r) for r in lines._check(spark.createDataFrame(pairs, "a long, b long"), forms, 0.8).collect()}
    limit = lambda a, b: int(max(len(texts[a]), len(texts[b])) * (1 - 0.8) + 1e-9)
    assert found == {(a, b) for a, b in pairs if _edit(texts[a], texts[b]) <= limit(a, b)}


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _near(forms, similarity=0.9):
    """By brute force: all pairs of forms whose edit similarity alone is high enough."""
    import duckdb

    letters = sorted({c for f in forms for c in f})
    counts = np.array([[f.count(c) for c in letters] for f in forms], dtype=np.int32).reshape(len(forms), -1)
    sizes, pairs = np.array([len(f) for f in forms]), []
    for i in range(1, len(forms)):
        allowed = np.floor(np.maximum(sizes[:i], sizes[i]) * (1 - similarity) + 1e-9)
        gap = counts[:i] - counts[i]  # an edit changes the count of one letter up and of one down
        bound = np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1))
        pairs += [(i, int(j), int(allowed[j])) for j in np.flatnonzero(bound <= allowed)]
    if not pairs:
        return set()
    con = duckdb.connect()
    con.execute("CREATE TABLE p (i INT, j INT, allowed INT, a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?, ?)", [(i, j, n, forms[i], forms[j]) for i, j, n in pairs])
    return {(forms[i], forms[j]) for i, j in con.execute("SELECT i, j FROM p WHERE levenshtein(a, b) <= allowed").fetchall()}


def _groups(pairs):
    parent = {}

    def root(f):
        parent.setdefault(f, f)
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in pairs:
        parent[root(a)] = root(b)
    return {f: root(f) for f in list(parent)}


def _compared(spark, docs):
    """The share of edit-similar pairs of which one line goes; fails where a line goes without a similar one before it, or where two equal ones stay."""
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("form", lines.normal_form(F.col("line"))).collect()
    gone = {(r.k1, r.k2): set(r.gone) for r in lines.repeats(docs).collect()}
    k1, k2 = lines.doc_keys()
    keys = {r.doc_id: (r.a, r.b) for r in docs.select("doc_id", k1.alias("a"), k2.alias("b")).collect()}
    kept = {r.form for r in rows if r.form and r.pos not in gone.get(keys[r.doc_id], ())}
    stay = collections.Counter(r.form for r in rows if r.form and r.pos not in gone.get(keys[r.doc_id], ()))
    assert all(n == 1 for n in stay.values())
    forms = sorted({r.form for r in rows if r.form})
    near = _near(forms)
    group = _groups(near)
    for f in set(forms) - kept:  # each that goes leaves one of its own group
        assert any(g in kept for g in group if group[g] == group.get(f)), f
    assert not any(r.form == "" and r.pos in gone.get(keys[r.doc_id], ()) for r in rows)
    return near, [p for p in near if not set(p) <= kept]


def test_op3_finds_edit_similar_lines(spark, prose):
    near, caught = _compared(spark, prose.select("doc_id", "text"))
    assert len(near) > 5 and len(caught) >= 0.9 * len(near)


def test_op3_recall_on_documents(spark):
    """Against all pairs by edit similarity alone, for every line of a table."""
    docs = spark.read.parquet(f"{DATA.rsplit('/', 1)[0]}/sf0.001/documents.parquet").select("doc_id", "text")
    near, caught = _compared(spark, docs)
    assert len(near) > 20 and len(caught) >= 0.9 * len(near)


@pytest.mark.parametrize(("words", "changed"), [(12, 1), (20, 1), (40, 2), (80, 4), (300, 15)])
def test_op3_recall_for_changed_words(spark, words, changed):
    """Pairs of lines of which some words are others."""
    rng = random.Random(words)
    syllables = ["ka", "to", "mi", "ren", "sol", "ta", "ver", "lin", "o", "e"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 2, 3, 3, 4))))
    texts = []
    while len(texts) < 240:
        a = [word() for _ in range(words)]
        b = list(a)
        for k in rng.sample(range(words), changed):
            b[k] = word()
        x, y = " ".join(a), " ".join(b)
        cost = sum(max(len(v), len(w)) for v, w in zip(a, b) if v != w)  # at least the edit distance
        if x != y and cost <= int(max(len(x), len(y)) * (1 - lines.SIMILARITY) + 1e-9):
            texts += [x, y]
    out = {r.doc_id: r._n_dropped for r in lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(out[k] for k in range(0, 240, 2)) == 0 and sum(out[k] for k in range(1, 240, 2)) >= 0.9 * 120


def test_op3_odd(odd_docs, no_docs):
    out = {r.doc_id: r for r in lines.deduplicated(odd_docs).collect()}
    assert out[3].text is None and out[5].text == "" and out[7]._n_dropped == 0
    ones = [r for r in lines.deduplicated(odd_docs).collect() if r.doc_id == 1]
    assert sorted(r._n_dropped for r in ones) == [0, 2] and sorted(len(r.text) for r in ones)[0] == 0
    assert out[2].text == "\nthird" and out[9]._n_dropped == 1
    assert out[1]._k1 == 3 and out[9]._k1 == 3
    rows = lines.without_repeated_lines(odd_docs)
    assert rows.columns == odd_docs.columns and rows.count() == odd_docs.count() - 1
    clash = odd_docs.withColumns({n: F.lit(5) for n in ("_n_lines", "_N_dropped", "_gone", "_nth", "_again", "k1", "h1")})
    kept = lines.without_repeated_lines(clash)
    assert kept.columns == clash.columns and kept.count() == rows.count() and {r._gone for r in kept.collect()} == {5}
    assert lines.without_repeated_lines(no_docs).count() == 0


def test_op3_large_buckets(spark):
    """Many forms in one bucket: near ones are found by their order, and far ones stay."""
    words = [f"x{k}" for k in range(200)]
    texts = [" ".join([*words[:150], f"y{i}", *words[150:]]) for i in range(40)] + ["short line", "another one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in lines.deduplicated(docs).where("_n_dropped = 0").collect()}
    assert kept == {0, 40, 41}


def test_op3_large_buckets_are_compared_completely(spark):
    """Many forms of one bucket that are far from each other, but for pairs: all pairs are found."""
    rng = random.Random(3)
    shared = ["alphabet", "boulevard", "catalogue", "dictionary"] * 3
    texts = []
    for _ in range(60):
        own = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9))) for _ in range(40)]
        texts += [" ".join([*shared, *own]), " ".join([*shared, *own[:-1], "changed"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lines.occurrences(docs).select("doc_id", F.explode("keys").alias("key")).collect()
    sizes = collections.Counter(r.key for r in rows)
    of = collections.defaultdict(set)
    for r in rows:
        of[r.doc_id].add(r.key)
    assert all(of[d] & of[d + 1] for d in range(0, 120, 2))
    kept = {r.doc_id for r in lines.deduplicated(docs).where("_n_dropped = 0").collect()}
    assert kept == set(range(0, 120, 2)), max(sizes.values())


def test_op3_makes_texts_once(spark, monkeypatch):
    """However many rounds a large bucket takes, documents are read for its texts once, and wide tables don't stay."""
    from pathlib import Path

    from pathloom.llm.common import shared_dir

    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage = words(150)
    texts = [" ".join([*words(40), *passage]) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id long, text string")
    there = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "pathloom"
    before, made, checks = set(there.glob("line*")), [], []
    texts_of, check = lines._texts, lines._check
    monkeypatch.setattr(lines, "_texts", lambda *a: made.append(a) or texts_of(*a))
    monkeypatch.setattr(lines, "_check", lambda *a: checks.append(a) or check(*a))
    assert {r.doc_id for r in lines.deduplicated(docs).where("_n_dropped > 0").collect()} == {30}
    assert len(checks) > 1 and len(made) == 1
    left = {p.name.rsplit("-", 1)[0] for p in set(there.glob("line*")) - before}
    assert not left & {"lines", "line-texts", "line-members", "line-buckets"} and "line-places" in left


def test_op3_settles_each_two_of_a_bucket(spark):
    """Of a bucket of many classes, all pairs that are in different groups by then are compared."""
    rng = random.Random(7)
    classes, keys = list(range(200)), [9] * 200
    met = spark.createDataFrame([(k, c, 100, 200) for k, c in zip(keys, classes)], "key long, c long, n int, members long")
    centres = spark.createDataFrame([(9, 3), (9, 50)], "key long, centre long")
    own = {c: rng.choice([0, 0, 0, 1, 2, c + 1000]) for c in classes}
    group = spark.createDataFrame([(c, g) for c, g in own.items() if g < 1000], "c long, g long")
    found = {(r.a, r.b) for r in lines.unsettled_pairs(lines.open_buckets(met, group), centres, 0.9, salt=8).collect()}
    g = {c: own[c] if own[c] < 1000 else c for c in classes}
    assert found == {(a, b) for a in classes for b in classes if a < b and g[a] != g[b] and not {a, b} & {3, 50}}


# Near-duplicates
def test_sampler_agrees_with_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 500, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:400], rng.integers(0, 1 << 62, 80, dtype=np.uint64)]))
    shared = {int(x): w for x, w in zip(a, rng.uniform(0.5, 3, len(a)))}
    wa, wb = np.array([shared[int(x)] for x in a]), np.array([shared.get(int(x), 1.0) * 1.2 for x in b])
    s = WeightedSampler(4000)([(a, wa), (b, wb)])
    assert abs((s[0] == s[1]).mean() - weighted_jaccard((a, wa), (b, wb))) < 0.03


def test_shingles_of_a_batch_are_those_of_each_text():
    texts = ["", " a ", "a b c d e f", "a b", "one\ttwo\x0bthree four five six a b"]
    s = Shingler()
    whole = s(pa.array(texts))
    assert [len(x) for x in whole] == [0, 1, 2, 1, 4]
    for t, x in zip(texts, whole):
        assert (s(pa.array([t]))[0] == x).all()


def _weighted_sets(texts, s):
    """Of each text: shingles and weights, by counting every document that holds a shingle."""
    words = {d: t.split() for d, t in texts.items()}
    grams = {d: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, w in words.items() if w}
    df = collections.Counter(g for c in grams.values() for g in c)
    n = len(texts)

    def idf(g):
        return 1.0 if df[g] < n // s.share + 1 else s.floor + (1 - s.floor) * min(1, max(0, np.log(n / df[g]) / np.log(s.share)))

    return {d: {g: k * idf(g) for g, k in c.items()} for d, c in grams.items()}


def _similarity(a, b):
    both = sum(min(w, b[g]) for g, w in a.items() if g in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _classes(sets, similarity):
    return _groups([(a, b) for a in sets for b in sets if a < b and _similarity(sets[a], sets[b]) >= similarity])


@pytest.mark.parametrize("share", [256, 8])
def test_op9(spark, prose, odd_docs, no_docs, share):
    """Classes are those of all pairs of weighted similarity 0.8, compared by brute force."""
    s = neardup.Settings(share=share)
    rows = {r.doc_id: r for r in neardup.near_duplicates(prose, s).collect()}
    sets = _weighted_sets({r.doc_id: r.text for r in prose.collect()}, s)
    if share == 8:
        assert len({w for c in sets.values() for w in c.values()}) > 2
    group = _classes(sets, 0.8)
    for d in sets:
        own = [e for e in group if group[e] == group.get(d)] or [d]
        assert rows[d].class_id == min(own) and rows[d].kept == (d == min(own))
    kept = neardup.distinct_documents(prose, s)
    assert {r.doc_id for r in kept.collect()} == {d for d, r in rows.items() if r.kept} and kept.columns == prose.columns
    odd = neardup.near_duplicates(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r.kept for r in odd if r.doc_id in (None, 3, 5, 7))
    assert sorted(r.kept for r in odd if r.doc_id == 1) == [False, True]
    clash = odd_docs.withColumns({n: F.lit(5) for n in ("_doc", "_K1", "_k2", "k1", "k2", "best")})
    left = neardup.distinct_documents(clash.drop("_k1"))
    assert left.columns == clash.drop("_k1").columns and left.count() == odd_docs.count() - 1
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.distinct_documents(no_docs).count() == 0


def test_op9_weights_are_those_of_counted_documents(spark, prose):
    s = neardup.Settings(share=8, cells=1 << 12)
    w = neardup.weights_of(prose, s)
    texts = {r.doc_id: r.text for r in prose.collect()}
    wanted = _weighted_sets(texts, s)
    shingler = Shingler(5)
    for d, t in texts.items():
        got = neardup.weighted(shingler, pa.array([t]), w)[0]
        assert sorted(np.round(got[1].astype(float), 4)) == sorted(np.round(list(wanted[d].values()), 4).tolist())


def test_op9_recall_against_brute_force(spark):
    """Every pair of weighted similarity 0.8 of a table, compared by brute force, shares a class but for what banding may miss; no class is without such pairs."""
    docs = spark.read.parquet(f"{DATA.rsplit('/', 1)[0]}/sf0.01/documents.parquet").where("text is not null")
    s = neardup.Settings()
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, s).collect()}
    sets = _weighted_sets({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, s)
    holders = collections.defaultdict(list)
    for d, c in sets.items():
        for g in c:
            holders[g].append(d)
    met = {(a, b) for ds in holders.values() if len(ds) > 1 for a in ds for b in ds if a < b}
    near = [p for p in met if _similarity(sets[p[0]], sets[p[1]]) >= 0.8]
    group = _groups(near)
    assert len(near) > 20 and sum(found[a] == found[b] for a, b in near) >= 0.98 * len(near)
    assert all(group.get(d) == group.get(c) for d, c in found.items() if c != d)


def test_op9_rows_of_one_doc_id_and_different_texts(spark):
    rng = random.Random(2)
    x, y = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(100)) for k in "xy")
    docs = spark.createDataFrame([(1, x), (1, y), (2, x + " more"), (3, y + " more")], "doc_id long, text string")
    rows = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in rows) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    assert sorted(r.text for r in neardup.distinct_documents(docs).collect()) == sorted([x, y])


@pytest.mark.parametrize("n", [3, 4, 16, 17, 20])
def test_op9_keeps_pairs_that_come_in_both_orientations(spark, n):
    """The centre (it shares one more bucket) has the largest number of its bucket, so others of it come first in a pair."""
    samples = list(range(48))
    rows = [(d, samples, [7, 1000 + d]) for d in range(1, n)] + [(n, samples, [7, 5]), (n + 1, [-1] * 48, [1000, 5])]
    found = {(r.a, r.b) for r in neardup.candidate_pairs(spark.createDataFrame(rows, "d long, samples array<int>, bands array<long>"), neardup.Settings()).collect()}
    met = {(min(p), max(p)) for p in found}
    assert len(met) == len(found) and all(a < b for a, b in met) and {(d, n) for d in range(1, n)} <= met
    assert n > 16 or len(met) == n * (n - 1) // 2


def test_op9_large_buckets_are_compared_completely(spark):
    """Distinct documents of one long template share a bucket; each has a near copy there. Any two of a bucket that are near share a class."""
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(10**6)}"
    template, texts = [word() for _ in range(200)], []
    for _ in range(200):
        own = [word() for _ in range(40)]
        texts += [" ".join(template + own), " ".join([*template, *own[:-1], "edited"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = neardup.Settings(bands=1, rows=1)
    weights = spark.sparkContext.broadcast(neardup.weights_of(docs, s))
    band = {r.doc_id: r.bands[0] for r in neardup.signed(neardup._lean(docs), weights, s).collect()}
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, s).collect()}
    assert max(collections.Counter(band.values()).values()) > 128
    assert found == {d: d - d % 2 if band[d] == band[d - d % 2] else d for d in band}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}


def test_numbered(spark):
    rows = [(k % 3, k * 7 % 50, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    found = {r.v: (r.rank, r.before) for r in numbered(df, ["o", "v"], ["g"], sums={"before": "v"}).collect()}
    order = sorted(rows)
    total, seen = 0, collections.Counter()
    for g, _, v in order:
        assert found[v] == (seen[g], total)
        seen[g] += 1
        total += v


def test_rounds_leave_one_table(spark):
    from pathlib import Path

    from pathloom.llm.common import shared_dir, stored
    from pathloom.llm.components import components

    edges = stored(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), "chain-edges")
    there = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "pathloom"
    before = set(there.glob("stars-*"))
    found = components(edges)
    assert len(set(there.glob("stars-*")) - before) == 1
    assert sorted(tuple(r) for r in found.collect()) == [(i, 0) for i in range(41)]
