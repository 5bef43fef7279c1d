import random

import cases
import pytest

from tallygrain.llm import templates as T


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, n int")


STORY = "Anna has {} apples and gives {} to {}, so how many apples does Anna keep after {} days"


def test_reparameterised_questions_are_caught_and_inconsistent_ones_left(spark):
    docs = [
        (1, "Before. " + STORY.format(9, 2, "Bob", 3) + " and more text follows here"),
        (2, STORY.format(9, 9, "Bob", 9)),  # one value for two different ones
        (3, "Nothing of the sort is said in this clean document about apples"),
        (4, STORY.format(5, 1, "Tom", 7)),  # verbatim
    ]
    found = {r["doc_id"]: r for r in T.leaks(cases.documents(spark, docs), items(spark, [(7, STORY.format(5, 1, "Tom", 7))])).collect()}
    assert set(found) == {1, 4}
    assert found[1]["reparameterised"] and not found[4]["reparameterised"]
    assert found[4]["coverage"] == 1 and found[4]["item_id"] == 7


def test_units_and_numbers():
    assert T.canonical("It ran 3.5 km in 20 Minutes, 5kg") == "it ran \x01 \x03 in \x01 \x03 \x01 \x03"
    # a name of several words is one slot
    assert T.canonical("we met Anna Smith. Then left") == "we met \x02 then left"
    assert T.canonical("we met Наталья McDonald in three days, 1,5/2 a_b") == "we met \x02 in \x01 \x03 \x01 a b"
    assert T.slots("we met Anna at 5 km", 3) == [["2anna"], ["2anna"], ["2anna", "15"], ["15", "3km"], ["15", "3km"], ["3km"]]


def test_against_brute_force(spark):
    rng = random.Random(9)
    bench = [(i, cases.sentence(rng, rng.randint(3, 30))) for i in range(20)]
    docs = []
    for i in range(150):
        t = cases.sentence(rng, 30)
        if i % 3 == 0:
            words = rng.choice(bench)[1].split()
            words[rng.randrange(len(words))] = "changed" if i % 2 else words[0]
            t += ". " + " ".join(words).upper() + "! " + cases.sentence(rng, 5)
        docs.append((i, t))
    want = set()
    for d, t in docs:
        w = T.canonical(t).split()
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, b in bench:
            v = b.split()
            n = len(v) - 4
            if n > 0 and sum(tuple(v[k : k + 5]) in own for k in range(n)) / n >= 0.8:
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in T.leaks(cases.documents(spark, docs), items(spark, bench)).collect()}
    assert got == want and want


@pytest.mark.parametrize("bits", [1, 22])
def test_bitmap_only_saves_work(spark, monkeypatch, bits):
    monkeypatch.setattr(T, "BITS", bits)
    rng = random.Random(3)
    b = cases.sentence(rng, 20)
    docs = cases.documents(spark, [(1, "x " + b + " y"), (2, cases.sentence(rng, 40))])
    assert [r["doc_id"] for r in T.leaks(docs, items(spark, [(3, b), (3, b), (4, None), (5, ""), (6, "two words")])).collect()] == [1]


def test_edges(spark):
    docs = cases.documents(spark)
    bench = items(spark, [(1, cases.texts()[0][1])])
    assert {r["doc_id"] for r in T.leaks(docs, bench).collect()} == {1, 2, 3, 9, -13}
    left = T.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 6
    assert T.leaks(docs.limit(0), bench).collect() == [] and T.leaks(docs, bench.limit(0)).collect() == []
    assert T.without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_names_anywhere_and_copies_in_other_case(spark):
    first = "Anna bought {} apples. Anna ate {}. How many are left?"
    inner = "on some days we see that Anna walks slowly to the old mill and then comes back home again"
    docs = [
        (1, first.format(12, 3).replace("Anna", "Tom")),
        (2, 'They said: "' + first.format(12, 3).replace("Anna", "Tom") + '"'),
        (3, inner.lower()),
        (4, inner.upper()),
        (5, "Tom bought 12 apples. Jim ate 3. How many are left?"),  # one name for two
        (6, "Nobody bought many apples and nobody ate them"),
    ]
    bench = [(7, first.format(9, 4)), (8, inner)]
    found = {(r["doc_id"], r["item_id"]): r for r in T.leaks(cases.documents(spark, docs), items(spark, bench)).collect()}
    assert set(found) == {(1, 7), (2, 7), (3, 8), (4, 8)}
    assert found[1, 7]["reparameterised"] and not found[3, 8]["reparameterised"] and found[4, 8]["coverage"] == 1


def test_a_conflicting_slot_costs_only_its_windows(spark):
    story = "a long walk begins at {} in the early morning and leads past many quiet farms with red roofs and some tall trees and fields and barns and along a cold stream to the old town at {}"
    docs = [(1, story.format(7, 8)), (2, story.format(7, 7))]
    found = T.leaks(cases.documents(spark, docs), items(spark, [(9, story.format(5, 5))])).collect()
    assert {r["doc_id"]: r["n_windows"] for r in found} == {1: 28, 2: 34}


def generated(rng, n):
    """Questions with slots: (item, the same with other values, a trap in which one name stands for two)."""
    people = ["Anna Smith", "Tom", "Jürgen", "Наталья", "Mary Jane Watson", "O", "McDonald", "Lee Wong"]
    people.remove("O")
    out = []
    for _ in range(n):
        body = [cases.sentence(rng, rng.randint(6, 10)) for _ in range(4)]

        def fill(a, b, x, y, u, body=body):
            return f"{body[0]} {a} {body[1]} {x} {u} and {b} {body[2]} {y} {u} with {a} {body[3]} {b}"

        (a, b, c, d), (x, y, v, w) = rng.sample(people, 4), rng.sample(["3", "12.5", "1,000", "seven", "twenty", "8/9"], 4)
        out.append((fill(a, b, x, y, "km"), fill(c, d, v, w, "miles"), fill(c, c, v, v, "miles")))
    return out


def test_recall_of_reparameterised_questions(spark):
    made = generated(random.Random(12), 60)
    docs = [(i, "as they said before " + other + " so it went") for i, (_, other, _) in enumerate(made)]
    traps = [(1000 + i, trap) for i, (_, _, trap) in enumerate(made)]
    found = T.leaks(cases.documents(spark, docs + traps), items(spark, [(i, item) for i, (item, _, _) in enumerate(made)])).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert sum((i, i) in pairs for i in range(60)) >= 0.9 * 60
    assert all(d == i for d, i in pairs)  # no trap, and no other item
    assert all(r["reparameterised"] for r in found)
