"""The registered queries over whole small tables: columns, types and row counts of their contracts; recall of personal data."""

import random

import pytest

from quiresmith.llm import pii, registry

WHERE = "/root/testdata/sf0.001"
LONG, TEXT, INT, REAL, FLAG = "bigint", "string", "int", "double", "boolean"
CONTRACTS = {
    "op1": {"doc_id": LONG, "n_email": LONG, "n_ip": LONG, "n_card": LONG, "n_phone": LONG, "base_sha256": TEXT, "spans": TEXT},
    "op2": {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": INT, "slot": LONG, "grown_shard": INT},
    "op3": {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": FLAG},
    "op4": {"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept_sha256": TEXT},
    "op5": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT},
    "op6": {"doc_id": LONG, "n_words": LONG, "n_removed": LONG, "kept_sha256": TEXT},
    "op7": {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL},
    "op9": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op10": {"doc_id": LONG, "class_id": LONG, "n_links": LONG},
}


@pytest.mark.parametrize("op", CONTRACTS)
def test_columns_and_rows(spark, op):
    (name,) = (n for n in registry.QUERIES if n.startswith(f"{op}_"))
    out = registry.QUERIES[name](spark, WHERE)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in CONTRACTS[op]} == CONTRACTS[op]
    table, key = ("embeddings", "vec_id") if op == "op3" else ("documents", "doc_id")
    want = sorted(r[key] for r in spark.read.parquet(f"{WHERE}/{table}.parquet").select(key).collect())
    assert sorted(r[key] for r in out.select(key).collect()) == want


def planted(n: int, seed: int = 9):
    """(text, spans) of documents, half of them with one value each of a kind that the classifier adds."""
    rng = random.Random(seed)
    words = "amber basil cedar delta ember flint grove hazel indigo jasper lemon maple nectar olive pepper quartz river saffron".split()
    prose = lambda: " ".join(rng.choices(words, k=rng.randint(8, 40)))
    secret = lambda: "".join(rng.choices("abcdefghijkmnopqrstuvwxyzABCDEFGH0123456789", k=rng.randint(20, 60))) + "7x"
    kinds = [
        lambda: ("secret", "password=", secret()), lambda: ("secret", "api_key: ", secret()), lambda: ("secret", "token ", "ghp_" + "".join(rng.choices("abcdef0123456789XYZ", k=36))),
        lambda: ("ssn", "ssn ", f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"), lambda: ("iban", "iban ", "GB82WEST12345698765432"),
        lambda: ("person", "signed by ", f"Dr. {rng.choice(['Anna', 'Peter', 'Maria', 'John'])} Keller"),
    ]
    out = []
    for k in range(n):
        before, after = prose(), prose()
        if k % 2:
            out.append((f"{before} {after}.", []))
            continue
        kind, key, value = kinds[k // 2 % len(kinds)]()
        start = len(before) + 1 + len(key)
        out.append((f"{before} {key}{value} {after}", [(kind, start, start + len(value))]))
    return out


def test_recall_of_added_spans(spark):
    """Of planted values at least 0.95 are found, whole; no document without one gets a span."""
    rows = planted(600)
    scanned = pii.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")).cache()
    got = {r.id: {tuple(x.split(":")) for x in r.spans.split(",") if x} for r in pii.label(scanned, pii.fit(scanned)).collect()}
    want = [(k, tuple(map(str, s))) for k, (_, spans) in enumerate(rows) for s in spans]
    assert sum(s in got[k] for k, s in want) >= 0.95 * len(want)
    assert not any(got[k] for k, (_, spans) in enumerate(rows) if not spans)


def test_long_runs_take_linear_time():
    import time

    for t in ("7" * 1_000_000, "a" * 1_000_000 + "@b c", "1." * 300_000, "a@" * 300_000):
        began = time.process_time()
        base = pii.base_spans(t)
        pii.candidates(t, [x for s in base for x in s])
        assert time.process_time() - began < 10
