import datetime as dt
import random
import shutil

import pytest

from evidex.llm.history import HistoryIndex, repeats
from evidex.llm.near_duplicates import components, expand_pairs, near_duplicate_groups, near_duplicates, registers
from evidex.llm.similarity import jaccard, normalise, shingles

WORDS = [f"word{i}x{i * 7919 % 97}" for i in range(400)]


def _texts():
    rnd = random.Random(4)
    rows = {}
    for g in range(30):
        base = [" ".join(rnd.choices(WORDS, k=12)) + "." for _ in range(8)]
        for k in range(1 + g % 4):
            own = list(base)
            if k:
                own[rnd.randrange(8)] = " ".join(rnd.choices(WORDS, k=6)) + "."
            rows[len(rows) + 1] = "  ".join(own).upper() if k == 2 else " ".join(own)
    rows[900], rows[901] = rows[1], rows[1].replace(" ", "\n")
    rows[902], rows[903], rows[904], rows[905] = None, "", "too short to count", "short" + " " * 60 + "text of forty characters!"
    rows[906] = rows[905]
    return rows


def _sets(rows):
    return {i: {n[k : k + 20] for k in range(max(1, len(n) - 19))} for i, t in rows.items() if t and len(t.strip()) >= 40 for n in [normalise(t)]}


def _true_pairs(rows, minimum=0.6):
    sets = _sets(rows)
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= minimum}


def test_jaccard_of_hashes_equals_sets():
    a, b = "the quick brown fox jumps over the lazy dog again", "the quick brown fox jumped over the lazy dog again"
    x, y = {a[i : i + 20] for i in range(len(a) - 19)}, {b[i : i + 20] for i in range(len(b) - 19)}
    assert jaccard(shingles(a), shingles(b)) == pytest.approx(len(x & y) / len(x | y))


def test_registers_depend_on_the_set_alone():
    regs, filled = registers(["abc" * 40, "abc" * 80, "x"])
    assert (regs[0] == regs[1]).all() and filled[2] == 1 and (regs[2] == regs[2][0]).all()


def test_pairs_equal_brute_force(spark):
    rows = _texts()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows.items()], "id long, text string, a string, rep int")
    got = [tuple(r) for r in expand_pairs(*near_duplicates(df)).collect()]
    assert len(got) == len(set(got)) and set(got) <= _true_pairs(rows)
    assert set(got) >= _true_pairs(rows, 0.72)  # banding may miss pairs close to the threshold


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert expand_pairs(*near_duplicates(df)).count() == 0
    assert repeats(spark.createDataFrame([], "id long, at timestamp_ntz, text string")).count() == 0


def _replay(rows, times):
    pairs, accepted, cases = _true_pairs(rows), set(), set()
    for i in sorted((i for i in _sets(rows) if times[i]), key=lambda i: (times[i], i)):
        near = {a + b - i for a, b in pairs if i in (a, b)}
        (cases if near & accepted else accepted).add(i)
    return cases


def test_replay_and_daily_batches_agree_with_brute_force(spark, tmp_path):
    rows, rnd = _texts(), random.Random(9)
    times = {i: None if i % 17 == 3 else dt.datetime(2024, 1, 1 + rnd.randrange(3), rnd.randrange(4)) for i in rows}
    want = _replay(rows, times)
    schema = "id long, at timestamp_ntz, text string, digest int"
    df = spark.createDataFrame([(i, times[i], t, 1) for i, t in rows.items()], schema)
    assert sorted(r.id for r in repeats(df).collect()) == sorted(want)
    index, got = HistoryIndex(spark, str(tmp_path / "index"), 4), []
    for day in (1, 2, 3):
        batch = spark.createDataFrame([(i, times[i], t, 1) for i, t in rows.items() if times[i] and times[i].day == day], schema)
        got += [r.id for r in index.take(batch, f"day-{day}").collect()]
    assert sorted(got) == sorted(want)
    last = sorted(r.id for r in index.take(batch, "day-3").collect())
    assert last == sorted(i for i in want if times[i].day == 3)  # taken again: the first answer
    again = HistoryIndex(spark, str(tmp_path / "index"), 4)
    assert sorted(r.id for r in again.take(batch, "day-3").collect()) == last
    with pytest.raises(ValueError):
        index.take(batch, "day 3")


@pytest.mark.parametrize("lost", [["taken"], ["taken", "repeats", "digests"]])
def test_a_batch_is_taken_again_after_a_crash(spark, tmp_path, lost):
    rows = _texts()
    times = {i: dt.datetime(2024, 1, 1 + i % 2, i % 24) for i in rows}
    df = spark.createDataFrame([(i, times[i], t) for i, t in rows.items()], "id long, at timestamp_ntz, text string")
    want = sorted(_replay(rows, times))
    index = HistoryIndex(spark, str(tmp_path / "index"), 2, texts=df.select("id", "text"))
    got = [r.id for r in index.take(df.where("day(at) = 1"), "a").collect()]
    index.take(df.where("day(at) = 2"), "b")
    for kind in lost:  # as if the run had ended before these were written
        spark.sql(f"ALTER TABLE {index._name}_{kind} DROP PARTITION (batch = 'b') PURGE")
    assert sorted(got + [r.id for r in index.take(df.where("day(at) = 2"), "b").collect()]) == want


def test_history_edges(spark, tmp_path):
    schema = "id long, at timestamp_ntz, text string"
    index = HistoryIndex(spark, str(tmp_path / "index"), 2)
    assert index.take(spark.createDataFrame([], schema), "none").count() == 0
    long = " ".join(f"w{i}" for i in range(60_000)) + ".\n"  # one paragraph far above any usual length
    short = [" ".join(WORDS[i : i + 3]) + f" {i}.\n" for i in range(0, 300, 3)]
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, at, long + "".join(short[:50])), (2, at, long + "".join(short[50:])), (3, None, long), (4, at, None), (5, at, "")], schema)
    assert [r.id for r in index.take(df, "some").collect()] == [2]


def test_a_hot_group_of_near_copies_is_settled_by_its_first_member(spark, monkeypatch):
    from evidex.llm import history

    rows, rnd = _texts(), random.Random(6)
    base = [" ".join(rnd.choices(WORDS, k=12)) + "." for _ in range(10)]
    for i in range(60):  # near-copies of one text, all different
        own = list(base)
        own[rnd.randrange(10)] = " ".join(rnd.choices(WORDS, k=8)) + f" {i}."
        rows[2000 + i] = " ".join(own)
    times = {i: dt.datetime(2024, 1, 1, rnd.randrange(24)) for i in rows}
    df = spark.createDataFrame([(i, times[i], t) for i, t in rows.items()], "id long, at timestamp_ntz, text string")
    want = sorted(_replay(rows, times))
    for hot in (5, 10**6):
        monkeypatch.setattr(history, "HOT", hot)
        assert sorted(r.id for r in repeats(df).collect()) == want


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (200, 202)]
    rnd.shuffle(pairs)
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_cover_every_record(spark):
    rows = _texts()
    got = {r.id: (r.group, r.links) for r in near_duplicate_groups(spark.createDataFrame([(i, t) for i, t in rows.items()], "id long, text string")).collect()}
    assert set(got) == set(_sets(rows)) and got[900] == got[1] and got[905][0] == got[906][0] == 905
