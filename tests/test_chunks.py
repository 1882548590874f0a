"""The Spark fold against a plain-Python statement of the splitter rules (property test)."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chatlake.operators import chunks as ch


def split_plain(text, size, overlap, sep):
    pieces = [p for p in text.split(sep) if p != ""]
    out, cur = [], []

    def joined(xs):
        return len(sep.join(xs)) if xs else 0

    def emit(xs):
        s = sep.join(xs).strip()
        if s:
            out.append(s)

    for d in pieces:
        if cur and joined(cur) + len(sep) + len(d) > size:
            emit(cur)
            while cur and (joined(cur) > overlap or joined(cur) + len(sep) + len(d) > size):
                cur = cur[1:]
        cur.append(d)
    emit(cur)
    return out


def _spark_split(spark, texts, size, overlap, sep):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ch.chunk_documents(df, chunk_size=size, overlap=overlap, separator=sep).collect()
    got = {i: [] for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_idx)):
        got[r.doc_id].append(r.chunk)
    return [got[i] for i in range(len(texts))]


def _random_text(rng, sep):
    n = rng.randint(0, 30)
    parts = []
    for _ in range(n):
        k = rng.choice([0, 1, 3, 10, 40, 90, 200])
        parts.append("".join(rng.choice("ab  c\tё") for _ in range(k)))
    return sep.join(parts)


def test_fold_equals_plain_python_random(spark):
    rng = random.Random(7)
    for size, overlap, sep in [(100, 30, "\n"), (1024, 256, "\n\n"), (50, 0, "\n"), (64, 64, "ab")]:
        texts = [_random_text(rng, sep) for _ in range(150)]
        assert _spark_split(spark, texts, size, overlap, sep) == [split_plain(t, size, overlap, sep) for t in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="xy \n", max_size=60), max_size=20))
def test_fold_property(spark, lines):
    text = "\n".join(lines)
    got = _spark_split(spark, [text], 40, 10, "\n")[0]
    assert got == split_plain(text, 40, 10, "\n")
    for c in got:  # a chunk is only longer than the size when one piece is
        assert len(c) <= 40 or all(len(p) > 40 for p in [c])


def test_composed_text_above_and_below_size(spark):
    short = "hello\nFrom the chat: c\n\nSender: s\nForwarded from: "
    long = "x" * 1100 + "\nFrom the chat: c\n\nSender: s\nForwarded from: "
    got = _spark_split(spark, [short, long], 1024, 256, "\n\n")
    assert got[0] == [short.strip()]
    # the long message splits into its body and sender part; the body stays whole (> 1024)
    assert got[1] == ["x" * 1100 + "\nFrom the chat: c", "Sender: s\nForwarded from:"]
    assert got == [split_plain(t, 1024, 256, "\n\n") for t in [short, long]]


def test_overlap_zero_and_256(spark):
    text = "\n".join(f"line {i:03d} " + "z" * 100 for i in range(40))
    for ov in (0, 256):
        got = _spark_split(spark, [text], 1024, ov, "\n")[0]
        assert got == split_plain(text, 1024, ov, "\n")
        assert all(len(c) <= 1024 for c in got)
    assert re.match("line 000", got[0])
