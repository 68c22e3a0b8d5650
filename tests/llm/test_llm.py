import datetime as dt
import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
import tiktoken
from pyspark.sql import functions as F

from callweave.llm import edits, leaks, neighbours, personal, personal_model, personal_samples, survivors, tokens

# --- p1 ------------------------------------------------------------------------------------------------------------

RECORDS = "rec_id long, run_id int, id_list array<string>, support_calls long, start_sum double, end_sum double, svlen_sum double, emitted_at timestamp_ntz"


def record(i, run, ids, support=1, start=1.0, svlen=1.0, day=1, end=1.0):
    return (i, run, ids, support, start, end, svlen, None if day is None else dt.datetime(2024, 1, day))


def test_survivors_follow_the_order(spark):
    rows = [
        record(1, 1, ["A ", "b"], start=float("nan"), day=3),
        record(2, 1, ["b", "a", None, " ", "a"], support=0, day=5),
        record(3, None, [" B", "A"], svlen=float("inf"), day=9),
        record(4, 2, ["B", "a"], support=None, svlen=None, start=None, day=2),
        record(5, 9, ["x"], day=1),
        record(6, 1, ["x"], day=None),
        record(7, 1, [], day=1),
        record(8, 1, None, day=1),
        record(9, 1, ["lonely"], day=1),
    ]
    df = spark.createDataFrame(rows, RECORDS).withColumn("record", F.lit("clash")).withColumn("first_record", F.lit(0))
    runs = spark.createDataFrame([(1, 3), (2, 5), (3, None), (None, 9)], "run_id int, trust_level int")
    got = {(r["first_rec_id"], r["field_name"]): r["rec_id"] for r in survivors.aggregate_survivors(df, runs).collect()}
    assert got == {(1, "start_sum"): 2, (1, "svlen_sum"): 2, (1, "support_calls"): 1, (5, "start_sum"): 6, (5, "svlen_sum"): 6, (5, "support_calls"): 6}
    assert survivors.aggregate_survivors(df.limit(0), runs).count() == 0


def test_branch_and_bound_equals_enumeration():
    rng = random.Random(4)
    for _ in range(200):
        names = ["a", "b", "c"]
        candidates = {n: sorted({((rng.randrange(4), rng.randrange(3), -i), f"{n}{i}", i) for i in range(rng.randrange(1, 5))}, reverse=True) for n in names}
        pairs = {p: {(x[1], y[1]) for x in candidates[p[0]] for y in candidates[p[1]] if rng.random() < 0.5} for p in (("a", "b"), ("b", "c"))}
        fits = lambda c: all(c[names.index(p)] is None or c[names.index(q)] is None or (c[names.index(p)][1], c[names.index(q)][1]) in v for (p, q), v in pairs.items())
        options = [[x for x in c if x] for c in itertools.product(*[[None, *x] for x in candidates.values()]) if fits(c)]
        value = lambda c: (len(c), *map(sum, zip(*(x[0] for x in c)))) if c else (0, 0, 0, 0)
        best = survivors.branch_and_bound(names, candidates, pairs)
        assert best and value(list(best.values())) == max(map(value, options))


def test_a_chain_that_can_not_be_met_keeps_its_group():
    """a -> b and b -> c, but no value of b stands with both: a and c, most trusted, survive and b stays open."""
    candidates = {"a": [((3, 0, -1), "a1", 1)], "b": [((2, 0, -1), "b1", 1), ((1, 0, -2), "b2", 2)], "c": [((5, 0, -2), "c2", 2)]}
    together = {("a", "b"): {("a1", "b1")}, ("b", "c"): {("b2", "c2")}}
    assert {n: x[2] for n, x in survivors.branch_and_bound(["a", "b", "c"], candidates, together).items()} == {"a": 1, "c": 2}
    assert {n: x[2] for n, x in survivors.branch_and_bound(["a", "c"], candidates, {("a", "c"): set()}).items()} == {"c": 2}


def test_dependent_survivors_equal_enumeration(spark):
    """Random groups with place -> length: the chosen values stand in one record, and no choice that does is trusted more."""
    rng = random.Random(6)
    rows = [record(i, rng.choice([1, 2, None]), [f"g{rng.randrange(25)}"], start=rng.choice([None, 1.0, 2.0, 3.0]), svlen=rng.choice([None, 5.0, 6.0]), day=rng.randrange(1, 9)) for i in range(160)]
    runs = spark.createDataFrame([(1, 3), (2, 5)], "run_id int, trust_level int")
    place = survivors.Bundle("place", ("start_sum",), F.col("start_sum").isNotNull())
    length = survivors.Bundle("length", ("svlen_sum",), F.col("svlen_sum").isNotNull())
    found = {}
    for r in survivors.aggregate_survivors(spark.createDataFrame(rows, RECORDS), runs, [("place", "length")], [place, length]).collect():
        found.setdefault(r["first_rec_id"], {})[r["field_name"]] = r["rec_id"]
    groups = {}
    for r in rows:
        groups.setdefault(r[2][0], []).append(r)
    score = lambda r: ({1: 3, 2: 5}.get(r[1], survivors._LOWEST), int(r[7].timestamp() * 1e6), -r[0])
    for members in groups.values():
        if len(members) < 2:
            continue
        got = found.get(min(r[0] for r in members), {})
        both = {(r[4], r[6]) for r in members if r[4] is not None and r[6] is not None}
        best = {c: {v: max(score(r) for r in members if r[k] == v) for v in {r[k] for r in members} - {None}} for c, k in (("place", 4), ("length", 6))}
        options = [(2, *map(sum, zip(best["place"][p], best["length"][q]))) for p, q in both]
        options += [(1, *v) for c in best for v in best[c].values()] if not both else []
        chosen = [r for n in got.values() for r in members if r[0] == n]
        assert (len(got), *map(sum, zip(*map(score, chosen)))) == max(options) if options else not got




def test_dependent_bundles_come_from_one_record(spark):
    rows = [record(1, 1, ["a"], start=1.0, svlen=None, day=9), record(2, 1, ["a"], start=2.0, svlen=7.0, day=5), record(3, 1, ["a"], start=None, svlen=8.0, day=8)]
    runs = spark.createDataFrame([(1, 3)], "run_id int, trust_level int")
    usable = lambda c: F.col(c).isNotNull()
    bundles = [survivors.Bundle("place", ("start_sum",), usable("start_sum")), survivors.Bundle("length", ("svlen_sum",), usable("svlen_sum")), survivors.Bundle("free", ("support_calls",), usable("support_calls"))]
    found = survivors.aggregate_survivors(spark.createDataFrame(rows, RECORDS), runs, [("place", "length")], bundles)
    assert {r["field_name"]: r["rec_id"] for r in found.collect()} == {"place": 2, "length": 2, "free": 1}


# --- p5 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("case", ["spread", "copies", "line", "few"])
def test_nearest_points_equal_brute_force(spark, case):
    rng = random.Random(case)
    make = {
        "spread": lambda i: (rng.choice("ab"), rng.gauss(0, 1000), rng.expovariate(0.01)),
        "copies": lambda i: ("a", 1.0, 1.0) if i % 3 else ("a", float(rng.randrange(9)), 2.0),
        "line": lambda i: ("a", float(rng.randrange(10_000_000)), 5.0),
        "few": lambda i: (f"b{i // 3}", float(i), 0.0),
    }[case]
    rows = [(i, *make(i)) for i in range(400)] + [(1000, "a", None, 1.0), (1001, "a", float("nan"), 1.0), (1002, None, 1.0, 1.0), (1003, "a", 1.0, float("inf"))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "point_id long, block_key string, px double, py double, rank string")
    got = {}
    for r in neighbours.nearest_points(df, "point_id", "block_key", "px", "py", 5, size=24).collect():
        got.setdefault(r["point"], []).append((r["rank"], r["neighbour"], r["distance"]))
    good = rows[:400]
    for i, b, x, y in good:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, c, u, v in good if c == b and j != i)[:5]
        assert [(n, d) for _, n, d in sorted(got.get(i, []))] == [(j, d) for d, j in near]
    assert set(got) <= set(range(400))


def test_hypothesis_scan_finds_most_and_bound_scan_all():
    rng = np.random.default_rng(1)
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    data = (rng.normal(size=(1500, 64)) * np.linspace(3, 0.1, 64)) @ rotation
    queries = data[:60]
    full = ((queries[:, None] - data[None]) ** 2).sum(axis=2)
    limit = np.sort(full, axis=1)[:, 10]
    true = {(q, c) for q in range(60) for c in np.flatnonzero(full[q] <= limit[q] * (1 + 1e-12))}
    blocks = [8, 16, 32, 64]
    exact = set(zip(*(x.tolist() for x in neighbours.scan_list(queries, data, limit * (1 + 1e-9), blocks, True))))
    tested = set(zip(*(x.tolist() for x in neighbours.scan_list(queries, data, limit * (1 + 1e-9), blocks, False))))
    assert true <= exact
    assert len(true & tested) >= 0.95 * len(true)


def test_nearest_vectors_find_most(spark):
    """Clustered vectors of 24 columns: at least 0.9 of the ten nearest by brute force; dirt takes no part."""
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(40, 24)) * 4)[rng.integers(40, size=3000)] + rng.normal(size=(3000, 24))
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(data)] + [(9000, None, ""), (9001, [float("nan")] * 24, ""), (9002, [1.0, None] * 12, ""), (9003, [1.0] * 3, ""), (9004, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, rank string")
    got = {}
    for r in neighbours.nearest_vectors(df, "vec_id", "v", 10, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query"], {})[r["near"]] = r["d2"]
    hits = 0
    for q in range(0, 3000, 20):
        d2 = ((data - data[q]) ** 2).sum(axis=1)
        d2[q] = np.inf
        true = set(np.argsort(d2, kind="stable")[:10].tolist())
        assert len(got[q]) == 10 and q not in got[q] and all(abs(d2[n] - d) < 1e-6 for n, d in got[q].items())
        hits += len(true & set(got[q]))
    assert hits / 1500 >= 0.9
    assert not set(got) & {9000, 9001, 9002, 9003, 9004}
    assert neighbours.nearest_vectors(df.limit(0), "vec_id", "v", 10).count() == 0


def test_nearest_points_of_nothing(spark):
    empty = spark.createDataFrame([], "point_id long, block_key string, x double, y double")
    assert neighbours.nearest_points(empty, "point_id", "block_key", "x", "y", 5).count() == 0


# --- p6 ------------------------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def mutate(rng, seq, edits_):
    out = list(seq)
    for _ in range(edits_):
        at, way = rng.randrange(len(out)), rng.randrange(3)
        if way == 0:
            out[at] = rng.choice("ACGT")
        elif way == 1:
            out.insert(at, rng.choice("ACGT"))
        else:
            del out[at]
    return "".join(out)


def test_near_records_equal_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (50, 55, 61, 89, 91, 100, 140, 60, 120)] + ["ACGTTG" * 20, "A" * 70]
    rows = []
    for i in range(150):
        pick = [mutate(rng, b, rng.randrange(0, 1 + len(b) // 8)) for b in rng.sample(base, rng.choice([1, 1, 1, 2, 3]))]
        rows.append((i, [rng.choice([p, p.lower()]) for p in pick] + rng.choice([[], ["A"], ["<DEL>"], [None]])))
    rows += [(200, None), (201, []), (202, ["*"]), (203, [base[0] + "X"]), (204, [base[6] * 3, base[6] * 3]), (205, [base[6] * 3, base[6] * 3])]
    df = spark.createDataFrame([(i, a, "clash") for i, a in rows], "rec_id long, alleles array<string>, seq string")
    long = {i: [x.upper() for x in a or [] if x and len(x) >= 50 and set(x.upper()) <= set("ACGTN")] for i, a in rows}
    close = lambda x, y: abs(len(x) - len(y)) <= max(len(x), len(y)) // 10 and levenshtein(x, y) <= max(len(x), len(y)) // 10
    want = set()
    for i, j in itertools.combinations(sorted(k for k, v in long.items() if v), 2):
        if len(long[i]) == len(long[j]) and any(all(close(x, y) for x, y in zip(long[i], p)) for p in itertools.permutations(long[j])):
            want.add((i, j))
    got = [tuple(r) for r in edits.near_records(df, "rec_id", "alleles").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    links = {r["rec_id"]: r["n_links"] for r in edits.record_links(df, "rec_id", "alleles").collect()}
    assert links == {k: sum(k in p for p in want) for k, v in long.items() if v}


def test_heavy_grams_are_split(spark, monkeypatch):
    """Runs of one letter and repeats share their grams: those are cut into a grid of fragments, and no pair is lost or counted twice."""
    monkeypatch.setattr(edits, "ENTRIES_PER_TASK", 400)
    rng = random.Random(3)
    seqs = ["A" * n for n in range(60, 120)] + ["CA" * n for n in range(30, 60)] + [mutate(rng, "A" * 80, 3) for _ in range(60)]
    seqs = sorted(set(seqs), key=seqs.index)
    counts = next(iter(edits._count_grams(iter([pd.DataFrame({"seq": seqs})]))))
    first, side = edits.fragment_of_gram(counts, 16)
    assert side.max() > 1
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "sid long, seq string")
    got = [tuple(sorted(r)) for r in edits.near_sequences(df).collect()]
    close = lambda x, y: abs(len(x) - len(y)) <= max(len(x), len(y)) // 10 and levenshtein(x, y) <= max(len(x), len(y)) // 10
    want = {(i, j) for i, j in itertools.combinations(range(len(seqs)), 2) if close(seqs[i], seqs[j])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_near_sequences_move_less_than_their_letters(spark, monkeypatch):
    """Several rounds lose no pair, whatever its length, and write neither entries nor chance meetings to disk."""
    monkeypatch.setattr(edits, "BLOCK_LETTERS", 9000, raising=False)
    rng = random.Random(17)
    base = ["".join(rng.choice("ACGTN" if n == 77 else "ACGT") for _ in range(n)) for n in (50, 77, 120, 200, 310, 330, 420)]
    seqs = sorted({mutate(rng, b, rng.randrange(0, 1 + len(b) // 8)) for b in base for _ in range(22)} - {s for s in base if len(s) < 50})
    seqs = [s for s in seqs if len(s) >= 50]
    df = spark.createDataFrame([(7 * i, s) for i, s in enumerate(seqs)], "sid long, seq string")
    moved = lambda: (time.sleep(1), spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite())[1]
    before = moved()
    got = [tuple(sorted(r)) for r in edits.near_sequences(df).collect()]
    assert moved() - before < sum(map(len, seqs))
    close = lambda x, y: abs(len(x) - len(y)) <= max(len(x), len(y)) // 10 and levenshtein(x, y) <= max(len(x), len(y)) // 10
    want = {(7 * i, 7 * j) for i, j in itertools.combinations(range(len(seqs)), 2) if close(seqs[i], seqs[j])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


@pytest.mark.parametrize("letters", ["A", "AC", "ACGTN"])
def test_bit_vectors_equal_edit_distance(letters):
    rng = random.Random(8)
    pairs = [("".join(rng.choice(letters) for _ in range(n)),) for n in [50, 59, 64, 100, 199, 319] for _ in range(25)]
    pairs = [tuple(sorted((a, mutate(rng, a, rng.randrange(0, 2 + len(a) // 8))), key=len, reverse=True)) for (a,) in pairs]
    pairs = [(a, b) for a, b in pairs if len(a) - len(b) <= len(a) // 10 and len(a) < 320]
    (a, n), (b, m) = (edits._read([p[k] for p in pairs]) for k in (0, 1))
    got = edits.within(a, np.cumsum(n) - n, n, b, np.cumsum(m) - m, m, n // 10)
    assert got.tolist() == [levenshtein(x, y) <= len(x) // 10 for x, y in pairs]


def test_filter_never_needs_less_than_one_segment():
    for n in range(50, 5000):
        q = 9 if n >= 90 else 8
        assert n // q - n // 10 >= 1
    lengths = np.arange(1, 3000)
    top = edits.longest_partner(lengths)
    assert all(t - t // 10 <= n < (t + 1) - (t + 1) // 10 for n, t in zip(lengths, top))


def test_near_records_of_nothing(spark):
    assert edits.near_records(spark.createDataFrame([], "rec_id long, alleles array<string>"), "rec_id", "alleles").count() == 0


# --- p7 ------------------------------------------------------------------------------------------------------------


def test_encoding_equals_the_public_encoder(spark):
    ranks = tokens.read_ranks()
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    alphabet = ["a", "B", "é", "ß", "字", "१", "7", " ", "  ", "\n", "\t", " ", "　", "'", "'s", "'ll", "'T", "!", "😀", "́", "<|endoftext|>", "re", "\0", "‍"]
    texts = ["", " ", "\n", "'", "don't I'll x's's ''s", "a" * 5000, *("".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(600))]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (0, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_texts(df, "doc_id", "text").collect()]
    assert len(got) == len(texts) + 2
    want = {i: reference.encode_ordinary(t) for i, t in enumerate(texts)} | {-1: []}
    assert all(want[i] == ids for i, ids in got)
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# --- p8 ------------------------------------------------------------------------------------------------------------

ITEM = "The amber mirror counts the painted cabinet beside the silent wagon. Every winter the hollow notebook carries the greasy ledger along the frozen lighthouse."
OTHER = "Les vieux moulins oublient les horlogers brisés sous les phares anciens près des jardiniers étroits malgré les aimants muets et tristes."


def srt(text, words=5):
    parts = text.split()
    cues = [" ".join(parts[i : i + words]) for i in range(0, len(parts), words)]
    return "\r\n\r\n".join(f"{n}\r\n00:00:0{n % 9},100 --> 00:00:0{n % 9},900\r\n<i>{c}</i>" for n, c in enumerate(cues, 1))


def test_leaks(spark):
    words = ITEM.split()
    cases = {
        1: (srt("Wait here. " + ITEM), {1}),
        2: (srt(" ".join(words[3:15])), {1}),
        3: (srt(" ".join(words[3:14])), set()),
        4: (srt(ITEM.upper().replace("AMBER", "AM8ER").replace("WAGON", "VVAGON")), {1}),
        5: (srt(OTHER).encode().decode("cp1252", "replace"), {2}),
        6: (srt(OTHER.replace("é", "e")) + "\n\n" + srt(ITEM.replace("painted", "[noise] pain­ted")), {1, 2}),
        7: (srt(" ".join(words[:8]) + " something else " + " ".join(words[8:16])), set()),
        8: (srt(" ".join(words[12:]) + " pause " + " ".join(words[:12])), {1}),
        9: (srt(OTHER.replace("é", "�")), {2}),
        10: ("", set()),
        11: (None, set()),
        12: (" \n ", set()),
        13: (srt("кто там снова " * 200), set()),
    }
    docs = spark.createDataFrame([(i, t, 5) for i, (t, _) in cases.items()], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, "too short"), (4, None)], "item_id long, item_text string")
    found = {}
    for r in leaks.leaks(docs, items).collect():
        found.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert found == {i: w for i, (_, w) in cases.items() if w}
    assert leaks.leaks(docs, items.limit(0)).count() == 0
    assert leaks.leaks(docs.limit(0), items).count() == 0


@pytest.mark.parametrize(
    "text, spoken",
    [
        ("1\n00:00:01,1 --> 00:00:02,1\nthe <amber mirror\n\n2\n00:00:03,1 --> 00:00:04,1\ncounts <i>the</i> cabinet", "the <amber mirror counts the cabinet"),
        ("\ufeff1\r\n00:00:01,1 --> 00:00:02,1\r\nthe year\r\n1984\r\n\r\n00:00:03,1 --> 00:00:04,1\r\nwas cold", "the year 1984 was cold"),
        ("1\n\n00:00:01,1 --> 00:00:02,1\n\nwait\n\n2\n\n00:00:03,1 --> 00:00:04,1\n\nhere", "wait here"),
        ("WEBVTT\n\n00:01.1 --> 00:02.1\nwait [loud\nnoise] here", "wait here"),
    ],
)
def test_cues_are_removed_before_markup(text, spoken):
    assert leaks.spoken_words(text) == spoken.split()


def tiled(documents, items):
    """(document, item, longest tile) by the matcher alone."""
    found = leaks.TileMatcher(list(enumerate(items))).match(list(enumerate(documents)))
    return sorted(r[:3] for r in found)


def test_a_damaged_word_keeps_all_words_it_may_be():
    olds = "old bold cold gold hold told fold sold"
    index = leaks.WordIndex([olds.split()])
    assert sorted(index.ids("xold")) == list(range(8))
    for old in olds.split():
        passage = f"amber mirror counts {old} painted cabinet beside silent wagon every winter hollow"
        damaged = passage.replace(f" {old} ", " xold ")
        assert tiled([damaged], [olds, passage]) == [(0, 1, 12)]


@pytest.mark.parametrize(
    "true, damaged",
    [("hall", "ball"), ("told", "fold"), ("cold", "eold"), ("in", "im"), ("a", "o"), ("shepherd", "shxphxrd"), ("telescope", "tel�scxpe"), ("clé", "cl�")],
)
def test_a_damaged_word_may_spell_another_one(true, damaged):
    others = "ball fold cold gold hold eold im o shopper telephone clb"
    passage = f"amber mirror counts silent wagon {true} painted cabinet beside every winter hollow"
    assert tiled([passage.replace(f" {true} ", f" {damaged} ")], [others, passage]) == [(0, 1, 12)]
    assert tiled([passage.replace(f" {true} ", " quarrelsome ")], [others, passage]) == []


def test_near_words_equal_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y and x != "?"))
        return row[-1]

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    words += ["ab" * 16 + "c", "ab" * 15]
    lookup = leaks._Lookup(words)
    assert lookup.near("ab" * 15 + "c") == lookup.near("ab" * 16) == {len(words) - 2, len(words) - 1}
    for _ in range(300):
        word = "".join(rng.choice("abcd?" if rng.random() < 0.2 else "abc") for _ in range(rng.randint(1, 10)))
        want = {i for i, w in enumerate(words) if distance(word, w) <= (2 if min(len(word), len(w)) >= leaks.TWO_EDITS else 1)}
        assert lookup.near(word) == (want if word.strip("?") else {i for i in want if len(words[i]) == len(word)})


def test_runs_are_found_without_a_right_first_choice():
    """Every fourth word is ambiguous or of another first choice: no four right ones stand in a row."""
    others = "bold cold gold hold told fold sold"
    passage = "amber mirror counts sold painted cabinet beside told silent wagon every hold"
    damaged = passage.replace("sold", "xold").replace("told", "zold").replace("hold", "kold")
    assert tiled([damaged, damaged + " " + damaged, damaged[5:]], [others, passage]) == [(0, 1, 12), (1, 1, 12)]


def test_runs_equal_brute_force():
    rng = random.Random(8)
    stock = "old bold cold gold hold told fold sold amber mirror counts painted".split()
    items = [" ".join(rng.choice(stock) for _ in range(rng.randint(3, 40))) for _ in range(30)]
    documents = []
    for _ in range(60):
        words = " ".join(rng.choice(items) for _ in range(3)).split()[rng.randrange(8) :]
        documents.append(" ".join(rng.choice(["xold", "zzzzz", w, w]) if rng.random() < 0.15 else w for w in words))
    matcher = leaks.TileMatcher(list(enumerate(items)), 6)
    want = []
    for d, text in enumerate(documents):
        ids = [matcher.index.ids(w) for w in text.split()]
        rows = np.full((max(map(len, ids)), len(ids)), -1)
        for k, x in enumerate(ids):
            rows[: len(x), k] = x
        for i, item in enumerate(items):
            tiles = leaks.greedy_tiles(rows, np.array([matcher.index.id_of[w] for w in item.split()]), 6)
            if tiles:
                want.append((d, i, tiles[0][2], sum(t[2] for t in tiles)))
    assert len(want) > 100
    assert sorted(r[:4] for r in matcher.match(list(enumerate(documents)))) == want


def test_tiles_are_longest_first_and_apart():
    item = np.arange(20)
    document = np.array([[9, 10, 11, 12, 13, 14, 99, 0, 1, 2, 3, 4, 5, 6, 7, 99, 3, 4, 5]])
    tiles = leaks.greedy_tiles(document, item, 4)
    assert tiles == [(7, 0, 8), (0, 9, 6)]


# --- p9 ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def finder():
    return personal.Finder(personal_model.load())


@pytest.mark.parametrize("held_out, precision, recall", [(False, 0.93, 0.90), (True, 0.82, 0.74)])
def test_held_out_accuracy(finder, held_out, precision, recall):
    """Fresh lines; with ``held_out`` their frames, names, streets and words are those that never served training."""
    lines = personal_samples.sample(1500, seed=424242, held_out=held_out)
    got = finder.spans([t for t, _ in lines])
    right = wrong = missed = 0
    for (text, labels), spans in zip(lines, got):
        want, begin = set(), -1
        for i, x in enumerate([*labels, 0]):
            if begin >= 0 and (x == 0 or x % 2):
                want.add((text[begin:i], personal_samples.KINDS[(labels[begin] + 1) // 2 - 1]))
                begin = -1
            if x and begin < 0:
                begin = i
        have = {(text[a:b], k) for a, b, k in spans}
        right, wrong, missed = right + len(want & have), wrong + len(have - want), missed + len(want - have)
    assert right / (right + wrong) > precision and right / (right + missed) > recall


@pytest.mark.parametrize("charset", ["latin-1", "cp1252"])
@pytest.mark.parametrize("times", [1, 2])
def test_wrongly_encoded_lines_read_like_right_ones(finder, charset, times):
    """Letters that became two or four count as what they stand for: no more and no fewer passages, each as it stands."""

    def wrong(text):
        for _ in range(times):
            text = "".join(c if c.isascii() else "".join(bytes([b]).decode(charset, "replace").replace("�", chr(b)) for b in c.encode()) for c in text)
        return text

    lines = ["Die überfüllten Fahrräder tauschen die", "Die spröden Hefte prüfen die", "Übersetzung von Jürgen Möllenhöfer", "Sous-titrage : Noémie Gormérillon", "Ayer vino Rocío Peñalver"]
    right = [{(kind, passage) for *_, kind, passage in found} for found in finder.find(lines)]
    assert [{(kind, passage) for *_, kind, passage in found} for found in finder.find([wrong(t) for t in lines])] == [{(k, wrong(p)) for k, p in r} for r in right]
    assert [len(r) for r in right] == [0, 0, 1, 1, 1]


def test_held_out_entries_never_train():
    for lists in (personal_samples.FRAMES, personal_samples.PLAIN):
        for text in lists.values():
            assert not set(personal_samples._pool(text, "|", True)) & set(personal_samples._pool(text, "|", False)) - {"{a}", "{e}", "{N}: {s}"}


def test_plain_lines_are_recognised_exactly(finder):
    """``surely_plain`` only spares decodings whose result is all outside."""
    texts = sorted((t for t, _ in personal_samples.sample(300, seed=11) if t), key=len, reverse=True)
    lengths = np.array([len(t) for t in texts])
    x = np.full((lengths[0], len(texts)), 32)
    for j, t in enumerate(texts):
        x[: len(t), j] = personal_model.encode(t)
    scores = finder.tagger.emissions(x, lengths)
    plain = finder.tagger.surely_plain(scores, lengths)
    paths = finder.tagger._viterbi(scores, lengths)
    assert not any(p.any() for p, sure in zip(paths, plain) if sure)
    for j in (0, 100, len(texts) - 1):  # a line alone is scored as it is among others
        alone = finder.tagger.emissions(x[: lengths[j], [j]], lengths[[j]])
        assert np.allclose(alone[:, 0], scores[: lengths[j], j], atol=1e-4)


def test_most_plain_lines_need_no_decoding(finder):
    """The test for plain lines is sharp: nearly all lines whose best path is all outside are seen to be so, and no other one."""
    texts = sorted((t for t, _ in personal_samples.sample(1500, seed=12) if t), key=len, reverse=True)
    lengths = np.array([len(t) for t in texts])
    x = np.full((lengths[0], len(texts)), 32)
    for j, t in enumerate(texts):
        x[: len(t), j] = personal_model.encode(t)
    scores = finder.tagger.emissions(x, lengths)
    plain = finder.tagger.surely_plain(scores, lengths)
    outside = np.array([not p.any() for p in finder.tagger._viterbi(scores, lengths)])
    assert not (plain & ~outside).any() and plain.sum() > 0.95 * outside.sum()


def test_gradients_are_right():
    lines = personal_samples.sample(4, seed=3)
    longest = max(len(t) for t, _ in lines)
    x, tags, mask = np.full((longest, 4), 32), np.zeros((longest, 4), int), np.zeros((longest, 4), bool)
    for j, (t, labels) in enumerate(lines):
        x[: len(t), j], tags[: len(t), j], mask[: len(t), j] = personal_model.encode(t), labels, True
    w = {k: v.astype(np.float64) for k, v in personal_model.initial().items()}
    _, grads = personal_model._gradients(w, x, tags, mask)
    for name, value in w.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        value[at] += 1e-2
        up = personal_model._gradients(w, x, tags, mask)[0]
        value[at] -= 2e-2
        down = personal_model._gradients(w, x, tags, mask)[0]
        value[at] += 1e-2
        assert abs((up - down) / 2e-2 - grads[name][at]) < 1e-2 * abs(grads[name][at]) + 1e-3


def test_documents(spark):
    text = "1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>This is Margaret\r\nHolloway speaking.</i>\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nMy phone number: +44 7700 900 746.\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nThe dog sees the table.\r\n"
    long = "\n\n".join(f"{n}\n00:00:01,000 --> 00:00:02,000\nThe small dog sees the old table." for n in range(3000)) + "\n\nYou can reach us at ida.fennlowe@post.example today.\n"
    rows = [(1, text), (2, None), (3, ""), (4, "  \n"), (5, long), (1, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = {tuple(r) for r in personal.personal_spans(df).collect()}
    assert got == {(1, "name", "Margaret Holloway"), (1, "phone", "+44 7700 900 746"), (5, "email", "ida.fennlowe@post.example")}
    out = {r["doc_id"]: r["text"] for r in personal.redacted(df).collect()}
    assert out[2] is None and out[3] == ""
    assert "This is <NAME> speaking.</i>" in out[1] and "My phone number: <PHONE>." in out[1]
    assert personal.personal_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line, kind, passage",
    [
        ("Send corrections to ELSIE.GARSKELL(AT)POST(DOT)EXAMPLE", "email", "ELSIE.GARSKELL(AT)POST(DOT)EXAMPLE"),
        ("Dial five five five oh one three nine, please.", "phone", "five five five oh one three nine"),
        ("Passport number: K4471902.", "id_number", "K4471902"),
        ("We moved to 14 Cedar Lane, Flat 2 last year.", "address", "14 Cedar Lane, Flat 2"),
    ],
)
def test_every_block_is_read(finder, line, kind, passage):
    assert (kind, passage) in {s[2:] for s in finder.find([line])[0]}


def test_labelled_lines_reach_the_tagger(finder):
    lines = [t for t, labels in personal_samples.sample(3000, seed=99) if any(labels)]
    texts = [t for t in dict.fromkeys(lines) if personal._clean(t)[0].strip()]
    reader = personal.Finder(personal_model.load())
    seen = []
    reader.spans = lambda cleaned: seen.extend(cleaned) or [[] for _ in cleaned]
    reader.find(texts)
    assert len(seen) == sum(len([b for b in personal.blocks(t) if personal._clean(t[slice(*b)])[0].strip()]) for t in texts)
    assert len(seen) >= len(texts)


@pytest.mark.parametrize(
    "line, want",
    [
        ("Bus 52 to Port Quillan.", set()),
        ("Ferry 38 to Port Quillan.", set()),
        ("Her passport number? 000 52 1990.", {("id_number", "000 52 1990")}),
        ("Le colis part au 188 bis, avenue aux Merles.", {("address", "188 bis, avenue aux Merles")}),
        ("Rappelez-nous au zéro sept deux neuf huit huit un un quatre six.", {("phone", "zéro sept deux neuf huit huit un un quatre six")}),
    ],
)
def test_numbers_count_by_what_they_stand_for(finder, line, want):
    assert {s[2:] for s in finder.find([line])[0]} == want


def test_borders_of_spoken_numbers_and_addresses():
    for kind, text, passage in [
        ("phone", "Appelez le zéro six trois neuf neuf huit, merci", "zéro six trois neuf neuf huit"),
        ("address", "Kupferweg 12, Altdorf.", "Kupferweg 12, Altdorf"),
        ("address", "Kupferweg 12, Altdorf...", "Kupferweg 12, Altdorf"),
        ("address", "12 Mill St.", "12 Mill St."),
        ("name", "Sie Ulla Vornfeld", "Ulla Vornfeld"),
        ("name", "Lisa in 't Veen", "Lisa in 't Veen"),
    ]:
        assert text[slice(*personal._trim(kind, text, 0, len(text)))] == passage


@pytest.mark.parametrize("phrase", ["Ihre Glocke", "Lärm in der Nacht", "Häuser im Nebel"])
def test_phrases_are_no_names(phrase):
    assert personal._trim("name", phrase, 0, len(phrase)) is None


def test_a_step_reads_two_characters(finder):
    """Half the steps; an odd end reads like one with a blank after it."""
    x = personal_model.encode("This is Margaret Holloway").astype(int)[:, None]
    assert personal_model.pairs(x).shape == (2, 13, 1)
    odd = finder.tagger.emissions(x, np.array([25]))
    even = finder.tagger.emissions(np.concatenate([x, [[32]]]), np.array([26]))
    assert odd.shape == (25, 1, personal_model.TAGS) and np.allclose(odd, even[:25], atol=1e-5)


@pytest.mark.parametrize("line", ["violines doblados bajo la lluvia.", "hölzernen Motoren ... Die samtenen", "sturen Keller wie Narren ..."])
def test_plain_blocks_are_left(finder, line):
    assert finder.find([line]) == [[]]


def test_windows_are_reconciled(finder):
    line = "This is Daniel Whitcombe speaking. " + "The small dog sees the old table. " * 8 + "Have you ever met Laura Whitcombe?"
    assert [line[a:b] for a, b, _ in finder.spans([line])[0]] == ["Daniel Whitcombe", "Laura Whitcombe"]
