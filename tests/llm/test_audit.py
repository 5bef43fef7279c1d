import random
import re
from itertools import permutations

import cases
import numpy as np

from tallygrain.llm import audit as A


def brute(docs, labels):
    text = lambda r: r["text"] or ""
    big = 2**63 - 1
    smallest = {}
    for r in docs:
        key = big if r["doc_id"] is None else r["doc_id"]
        smallest[text(r)] = min(smallest.get(text(r), big), key)
    out = {}
    for r in docs:
        t = text(r)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": (big if r["doc_id"] is None else r["doc_id"]) > smallest[t],
        }
        good = any(i == r["doc_id"] and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == r["doc_id"] and x == 1 for i, _, x in labels if i is not None)
        part = r["source"] or ""
        for order in permutations("ABCDE"):
            earlier = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((part, "".join(order), step), [0] * 6)
                here = fails[f] and not earlier
                for k, hit in enumerate((not earlier and not fails[f], here, fails[f] and earlier, fails[f] and sum(fails.values()) == 1, here and good, here and toxic)):
                    row[k] += hit
                earlier = earlier or fails[f]
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row[1]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_equals_brute_force(spark):
    rng = random.Random(9)
    rows = cases.texts()
    for i in range(60):
        body = cases.sentence(rng, rng.choice([150, 260])) if i % 4 else "same " * 230
        rows.append((200 + i, body.upper() if i % 5 == 0 else body + (" #" if i % 3 == 0 else "")))
    rows += [(300 + i, rows[20][1]) for i in range(5)] + [(None, rows[20][1])]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(190, 300)] + [(8, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None)]
    docs = cases.documents(spark, rows)
    found = sorted(map(tuple, A.filter_audit(docs, marks(spark, labels)).collect()))
    assert found == brute(docs.collect(), labels)


def test_empty_tables(spark):
    docs = cases.documents(spark)
    assert A.filter_audit(docs.limit(0), marks(spark, [(1, 1, 1)])).collect() == []
    found = A.filter_audit(docs, marks(spark, [])).collect()
    assert len(found) == 600 * len({r["source"] or "" for r in docs.collect()})
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in found)


def test_contractions_add_up():
    tensor = np.random.default_rng(1).integers(0, 9, (4, 3, *[2] * 5))
    for order in A.ORDERS:
        left = tensor.sum((2, 3, 4, 5, 6))
        for step in range(1, 6):
            x = A.contracted(tensor, order, step)
            left = left - x["removed"]
            assert (x["kept"] == left).all() and (x["redundant"] >= 0).all() and (x["unique_fails"] <= x["removed"]).all()


def test_words_split_at_ascii_space_only():
    # a no-break space joins words; a control character below \x20 other than \t to \r does too
    assert A.failures(("a b " * 199).encode(), 800) & 0b1000
    assert not A.failures(" ".join(f"w{i}" for i in range(200)).encode(), 900) & 0b1100
