"""Every registered query of the subpackage: against its SQL, or against a brute-force version, on the smallest tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from chatlake.llm import minhash, pii
from chatlake.llm import queries as Q
from chatlake.plans.check import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, con, name):
    r = compare(spark, SF, name, Q.QUERIES[name], Q.SQL[name], con)
    assert r["cols_match"] and r["hash_match"] and r["spark_rows"] == r["oracle_rows"], r


def shingle_set(text):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, percent=75):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    where, shared = defaultdict(list), Counter()
    for i in sorted(sets):
        for x in sets[i]:
            where[x].append(i)
    for ids in where.values():
        shared.update((a, b) for n, b in enumerate(ids) for a in ids[:n])
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            comp[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_op1_equals_brute_force(spark, texts):
    rows = Q.op1_minhash_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_components(texts)
    assert len(rows) == len(texts)


def test_op2_held_out_accuracy(spark):
    rows = Q.op2_toxicity_grammar(spark, LABELLED).collect()
    labels = dict(duckdb_connection(LABELLED).execute("SELECT doc_id, toxic FROM labels").fetchall())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in seen) / len(seen) > 0.93
    assert sum(p and y for p, y in seen) / sum(y for _, y in seen) > 0.6  # few toxic documents are labelled at this size


def reference_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_op4_base_and_added_spans(spark, texts):
    for r in Q.op4_pii_weak_supervision(spark, SF).collect():
        base = reference_spans(texts[r.doc_id])
        count = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in pii.KINDS)
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r.spans.split(",")))


def brute_repeats(texts, length=200):
    seen = Counter(t[k:k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                cover[k:k + length] = True
        edges = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        out[i] = len(t), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()
    return out


def test_op8_equals_brute_force(spark, texts):
    rows = Q.op8_suffix_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_repeats({i: t.encode() for i, t in texts.items()})


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken
    with open(Q.bpe_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op9_equals_tiktoken(spark, texts):
    enc = tiktoken_encoding()
    for r in Q.op9_byte_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_stages(spark, texts, con):
    """Every stage against a plain version of its decision, on what the stage before it kept."""
    sources = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scored = {r.doc_id: r.score for r in Q.op2_toxicity_grammar(spark, SF).collect()}
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i in scored if scored[i] < 0.3)
    left = stages["exact dedup"](spark, clean, SF)
    assert left.columns == docs.columns
    first = {}
    for i in sorted(i for i in scored if scored[i] < 0.3):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert sorted(r.doc_id for r in left.collect()) == sorted(first.values())
    single = stages["minhash near-dedup"](spark, left, SF)
    assert single.columns == docs.columns
    kept = sorted(i for i, (_, _, k) in brute_components({i: texts[i] for i in first.values()}).items() if k)
    assert sorted(r.doc_id for r in single.collect()) == kept
    mixed = stages["mixing"](spark, single, SF)
    assert mixed.columns == docs.columns
    count = Counter(r.doc_id for r in mixed.collect())
    assert set(count) <= set(kept) and max(count.values()) <= 3
    rows = duckdb.connect()
    rows.register("documents", pa.table({"doc_id": kept, "source": [sources[i] for i in kept], "text": [texts[i] for i in kept]}))
    taken = {r[0]: r[-1] // r[1] for r in rows.execute(f"SELECT doc_id, size, taken FROM ({Q.SQL['op6_curriculum_mix']})").fetchall() if r[1]}
    assert {i: count[i] for i in taken} == taken  # as many copies as the mix's SQL takes of what the stage was given
    encoded = stages["bpe"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in encoded) == count
    enc = tiktoken_encoding()
    assert all(r.round_trip and r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in encoded)


def test_minhash_never_misses_at_the_threshold():
    """The documented miss probability of the banding at the threshold."""
    assert (1 - (minhash.PERCENT / 100) ** minhash.ROWS) ** minhash.BANDS < 1e-5
