import numpy as np
import pytest

from tallygrain.llm import cells as C


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, cid string, weight int")


def brute(rows, similarity):
    ok = [i for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: set() for i in range(len(rows))}
    unit = {i: np.array(np.float32(rows[i][1]), float) for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity:
                near[i].add(j)
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((key, len(near[i]), comp, key == comp))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("cell", "block", "similarity"), [(512, 2048, 0.98), (6, 2048, 0.98), (6, 4, 0.9), (3, 5, 0.5)])
def test_against_brute_force(spark, monkeypatch, cell, block, similarity):
    monkeypatch.setattr(C, "CELL", cell)
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(cell)
    base = rng.normal(size=(30, 8))
    rows = []
    for i in range(160):
        v = base[rng.integers(30)] + rng.normal(size=8) * rng.choice([0, 0.02, 0.08, 0.3])
        rows.append((i * 3, [float(np.float32(x)) for x in v * rng.choice([1, 1, 5])], int(rng.integers(2))))
    got = sorted((tuple(r) for r in C.embedding_dedup(table(spark, rows), similarity).collect()), key=repr)
    assert got == brute(rows, similarity)
    assert any(r[1] for r in got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1),
        (12, [1.0, 0.0], 1), (-4, [1e30, 1e25], 1), (13, [1e-30, 0.0], 1), (14, [-1.0, 0.0], 1),
    ]
    found = C.embedding_dedup(table(spark, rows)).collect()
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert len(found) == len(rows)
    assert {(1, 5, -4, False), (2, 5, -4, False), (12, 5, -4, False), (13, 5, -4, False), (-4, 5, -4, True)} <= got
    assert {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 14)} <= got
    assert (None, 0, None, True) in got
    assert C.embedding_dedup(table(spark, rows).limit(0)).collect() == []
