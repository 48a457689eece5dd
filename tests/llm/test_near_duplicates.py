"""Near duplicates against brute force at their own threshold."""

import random

import numpy as np
import pytest

from quire.llm import fingerprint, queries


def _edited(rng, text, rate, letters):
    out = []
    for c in text:
        if rng.random() >= rate:
            out.append(c)
        elif (k := rng.randrange(3)) < 2:
            out += [rng.choice(letters)] if k else [c, rng.choice(letters)]
    return "".join(out)


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))
        b = _edited(rng, a, rng.choice([0.0, 0.1, 0.3, 1.0]), "abc")
        want, most = _plain(a, b), rng.randint(0, 40)
        assert fingerprint.edit_distance(a, b, most) == (want if want <= most else None)
        assert fingerprint.similar(a, b, 0.8) == (5 * want <= max(len(a), len(b)))


@pytest.mark.parametrize("rate, least", [(0.02, 0.95), (0.05, 0.93), (0.1, 0.85)])
def test_keys_recall_edited_texts(rate, least):
    rng = random.Random(2)
    for size in (60, 300, 3000):
        texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(size)) for _ in range(50)]
        codes = lambda ts: [fingerprint.code_points(t.encode()) for t in ts]
        own, other = fingerprint.near_keys(codes(texts)), fingerprint.near_keys(codes([_edited(rng, t, rate, "abcdefghijklmnop ") for t in texts]))
        found = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(own, other, strict=True)])
        assert found >= least, (size, rate, found)


def test_members_are_linked_beyond_their_head(spark):
    """Chains of edits: neighbours are near, ends are not; classes equal the components of brute force."""
    rng = random.Random(5)
    letters, rows = "abcdefgh ", []
    for _ in range(6):
        text = "".join(rng.choice(letters) for _ in range(250))
        for _ in range(6):
            rows.append((len(rows) * 7 % 36, text))
            text = _edited(rng, text, 0.08, letters)
    label = {i: i for i, _ in rows}
    for _ in rows:
        for i, a in rows:
            for j, b in rows:
                if i < j and label[i] != label[j] and 5 * _plain(a, b) <= max(len(a), len(b)):
                    low, high = sorted((label[i], label[j]))
                    label = {k: low if v == high else v for k, v in label.items()}
        break
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label and len(set(label.values())) == 6


def test_the_query_gives_every_document_a_class(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.queries()["op10_near_duplicates"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert any(r["class_id"] < r["doc_id"] for r in got) and all(r["class_id"] <= r["doc_id"] for r in got)
