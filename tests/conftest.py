from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from ntuple.session import local_session

    session = local_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy(spark):
    """Nine labelled bit rows of nine bits."""
    # The toy rows that results are known for.
    rows = {
        "cold": ["111000000", "111100100", "111000100", "111100000", "101010101"],
        "hot": ["000011111", "001001111", "001011111", "000001111"],
    }
    data = [
        (i, [int(b) for b in text], label)
        for i, (label, text) in enumerate((lab, t) for lab, ts in rows.items() for t in ts)
    ]
    return spark.createDataFrame(data, "row_id bigint, bits array<tinyint>, label string").cache()


def make_rows(n: int, width: int, seed: int, labels=("a", "b", "c")):
    """Reproducible noisy rows: each label prefers its own third of the bits."""
    import random

    rng = random.Random(seed)
    out = []
    for i in range(n):
        lab = labels[rng.randrange(len(labels))]
        k = labels.index(lab)
        bits = [
            int(rng.random() < (0.8 if j * len(labels) // width == k else 0.2)) for j in range(width)
        ]
        out.append((i, bits, lab, round(rng.random() + k, 3)))
    return out
