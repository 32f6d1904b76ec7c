import random

import pytest

from rillmark.operators import ordered


def brute(filtered, original):
    """(row, earliest, latest, outcome) of one sequence, by two loops; both sides are (place, key) in order."""
    held = {k for _, k in original}
    f = [(r, k) for r, k in filtered if k in held]

    def greedy(rows, places):
        out, at = {}, 0
        for r, k in rows:
            while at < len(places) and places[at][1] != k:
                at += 1
            if at == len(places):
                return None
            out[r] = places[at][0]
            at += 1
        return out

    first, last = greedy(f, original), greedy(f[::-1], original[::-1])
    out = []
    for r, k in filtered:
        if k not in held:
            out.append((r, None, None, ordered.NO_KEY))
        elif first is None:
            out.append((r, None, None, ordered.NO_PLACE))
        else:
            out.append((r, first[r], last[r], ordered.MATCHED if first[r] == last[r] else ordered.AMBIGUOUS))
    return out


@pytest.mark.parametrize("chunk", [5])
def test_sequences_against_two_loops(spark, chunk):
    """Many sequences at once: keys that repeat, a key with a third of the rows, rows dropped and swapped, in chunks."""
    rng = random.Random(chunk)
    filtered, original, want = [], [], []
    for g in range(25):
        keys = [rng.choice(["hot", rng.randrange(4), f"only {i}"]) for i in range(rng.randrange(1, 40))]
        o = [(10 * i, str(k)) for i, k in enumerate(keys)]
        f = [(i, k) for i, (_, k) in enumerate(o) if rng.random() < 0.7]
        if g % 5 == 0 and len(f) > 1:
            (a, x), (b, y) = f[0], f[-1]
            f[0], f[-1] = (a, y), (b, x)
        if g % 7 == 0:
            f.append((99, "lacking"))
        name = None if g == 3 else f"g{g}"
        filtered += [(name, r, k, 1) for r, k in f]
        original += [(name, p, k) for p, k in o]
        want += [(name, *r) for r in brute(f, o)]
    rng.shuffle(filtered)
    rng.shuffle(original)
    fs = spark.createDataFrame(filtered, "g string, row long, k string, seg int")
    os = spark.createDataFrame(original, "g string, position long, k string")
    got = [tuple(r) for r in ordered.ordered_matches(fs, os, ["k"], by=["g"], chunk=chunk).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[4] for r in got} == {ordered.MATCHED, ordered.AMBIGUOUS, ordered.NO_PLACE, ordered.NO_KEY}


def frames(spark, filtered, original):
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(filtered)], "row_id long, question string, answer string")
    o = spark.createDataFrame([(i, *r) for i, r in enumerate(original)], "row_id long, question string, final_answer string, r1_solution_1 string, topic string, difficulty double")
    return f, o


def original(question="Solve x.", answer="2", solution="Reasoning... \\boxed{2}"):
    return question, answer, solution, "Algebra", 6.0


def test_provenance_of_one_row(spark):
    f, o = frames(spark, [("Solve x.", "$2$")], [original("Different question.", "99"), original(answer="2 ")])
    assert [tuple(r) for r in ordered.provenance(f, o).collect()] == [("deepmath-level6-000000", "Solve x.", "Reasoning... \\boxed{2}", 0, 1, "Algebra", 6.0)]


def test_neighbours_tell_duplicates_apart(spark):
    f, o = frames(spark, [(q, "2") for q in ("Left anchor.", "Duplicate.", "Right anchor.")], [original(q) for q in ("Before.", "Duplicate.", "Left anchor.", "Duplicate.", "Right anchor.")])
    got = sorted((r["id"], r["original_dataset_index"]) for r in ordered.provenance(f, o).collect())
    assert got == [("deepmath-level6-000000", 2), ("deepmath-level6-000001", 3), ("deepmath-level6-000002", 4)]


@pytest.mark.parametrize(
    "filtered,originals,reason",
    [
        ([("Left", "2"), ("Dup", "2"), ("Right", "2")], [original(q) for q in ("Left", "Dup", "Dup", "Right")], "ambiguous ordered original match for filtered row 1"),
        ([("Solve y.", "2")], [original()], "no original question match for filtered row 0"),
        ([("Solve x.", "3")], [original()], "answer mismatch for filtered row 0"),
        ([("Solve x.", "3")], [original(answer=" ")], "missing or empty final_answer for filtered row 0"),
        ([("B", "2"), ("A", "2")], [original("A"), original("B")], "no ordered original match for filtered row 0"),
    ],
)
def test_provenance_says_what_is_wrong(spark, filtered, originals, reason):
    f, o = frames(spark, filtered, originals)
    with pytest.raises(ValueError, match=reason):
        ordered.provenance(f, o)


def test_empty_sides(spark):
    f, o = frames(spark, [("A", "2")], [original("A")])
    one, two = f.select(f.row_id.alias("row"), "question"), o.select(o.row_id.alias("position"), "question")
    assert ordered.ordered_matches(one.limit(0), two, ["question"]).collect() == []
    assert [tuple(r) for r in ordered.ordered_matches(one, two.limit(0), ["question"]).collect()] == [(0, None, None, ordered.NO_KEY)]
