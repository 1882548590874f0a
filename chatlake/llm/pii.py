"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

**Base spans** are fixed patterns: e-mail, IPv4, payment card (Luhn) and phone number, leftmost and without overlap per kind; they always stay.

**Candidates** are found by wider patterns: written-out addresses (``name at host dot org``), numbers with other separators or
without a plus. For each of them six labelers vote yes, no or nothing:

* *regex*: the candidate is a base span; *validity*: Luhn sum, parts up to 255, number of digits, form of the host;
* *gazetteer*: top-level domains, card issuers' prefixes, reserved networks, telephone groups;
* *context*: words before it that announce such data, or that announce something else (version, price, page);
* *boundary*: whether it stands alone or inside a longer token; *form*: the usual grouping of its digits.

1. One pass counts the vote patterns of all candidates of the corpus (kind, six votes, length class: a bounded table, aggregated before
   the shuffle).
2. EM over that table estimates per kind the share of true candidates and each labeler's reliability for both classes (two
   classes, votes independent given the class, add-one smoothing, started from the majority of the votes).
3. A logistic regression over the votes and the length class is trained on EM's posteriors, weighted by the counts: the span classifier.
4. A second pass keeps candidates of probability ``ACCEPT`` or more that touch no base span.

Every pattern is scanned in time linear in the text, however long its runs are. Defined results: a null or empty text has no spans; offsets are code points, end exclusive; rows that repeat are read alike; other columns of the input stay,
except ``base`` and ``spans``, which are replaced; an empty table, or one without candidates, learns a classifier that accepts nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import ship

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
LABELERS = ("regex", "validity", "gazetteer", "context", "boundary", "form")
LENGTHS = (8, 10, 12, 14, 17, 20)  # length classes of the digits or of the address

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{1,63}){1,8}")
_NUMBER = re.compile(r"(?<![0-9])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){7,18}(?![0-9])")
_DOMAINS = frozenset("com org net edu gov io info de fr es uk eu us it nl ch at be pt br ca au jp co".split())
_ANNOUNCE = {"email": "mail email e-mail contact write address correo courriel adresse", "ip": "ip host server address login adresse",
             "card": "card visa mastercard credit debit karte carte tarjeta pay payment", "phone": "phone call tel telephone mobile fax cell telefon téléphone teléfono appelez llame"}
_ANNOUNCE = {k: frozenset(v.split()) for k, v in _ANNOUNCE.items()}
_OTHERWISE = frozenset("version v release isbn issn price total page line section no nr id order invoice".split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed and then by place."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        host = _HOST.match(text, at + 1) if lo < at else None
        if host:
            out.append(("email", lo, last := host.end()))
        at = text.find("@", max(at + 1, last))
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else 2 if no else 0


def votes(kind: str, text: str, a: int, b: int, is_base: bool) -> tuple[int, ...]:
    """The labelers' votes (0 nothing, 1 yes, 2 no) and the candidate's length class."""
    found = text[a:b]
    digits = "".join(_DIGITS.findall(found))
    before = [w.lower() for w in _WORD.findall(text[max(0, a - 40):a])][-4:]
    alone = not (a and (text[a - 1].isalnum() or text[a - 1] in "_/=#")) and not (b < len(text) and (text[b].isalnum() or text[b] in "_/=%"))
    if kind == "email":
        host = re.split(r" ?(?:\(dot\)|\[dot\]| dot |\.) ?", re.split(r"@|\(at\)|\[at\]| at ", found)[-1].strip())
        valid, known, form = len(host) > 1 and host[-1].isalpha() and len(host[-1]) > 1, host[-1].lower() in _DOMAINS, "@" in found
        size = len(found)
    elif kind == "ip":
        parts = found.split(".")
        valid, known = len(parts) == 4 and all(map(_small, parts)), parts[0].lstrip("0") not in ("", "127", "255")
        form, size = all(p == "0" or p[0] != "0" for p in parts), len(digits)
    elif kind == "card":
        valid, known = luhn(digits), digits[0] in "3456"
        form, size = bool(re.fullmatch(r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", found)), len(digits)
    else:
        valid, known = 9 <= len(digits) <= 15, "555" in digits or found.startswith("+")
        form, size = bool(re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}", found)), len(digits)
    announced, other = any(w in _ANNOUNCE[kind] for w in before), any(w in _OTHERWISE for w in before)
    return (_vote(is_base, not is_base), _vote(valid, not valid), _vote(known, not known), _vote(announced, other), _vote(alone, not alone),
            _vote(form, not form), int(np.searchsorted(LENGTHS, size)))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """Wider finds with their votes; the base spans among them are marked by the first vote."""
    found = [(k, a, b, True) for k, a, b in base]
    if " dot " in text or "(dot)" in text or "[dot]" in text or "(at)" in text or "[at]" in text:
        found += [("email", *m.span(), False) for m in _SPOKEN.finditer(text)]
    for m in _NUMBER.finditer(text):
        digits = sum(map(len, _DIGITS.findall(m[0])))
        kind = "ip" if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", m[0]) else "card" if digits >= 13 else "phone"
        found.append((kind, *m.span(), False))
    taken = sorted((a, b) for _, a, b in base)
    out, k = [], 0
    for kind, a, b, is_base in sorted(found, key=lambda x: (x[1], x[2], not x[3])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if is_base or not (k < len(taken) and taken[k][0] < b):
            out.append((kind, a, b, votes(kind, text, a, b, is_base)))
    return out


def vote_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, votes, n): how many candidates of the whole corpus have each vote pattern."""
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                text = text.as_py() or ""
                counts.update((k, v) for k, _, _, v in candidates(text, base_spans(text)))
            if counts:
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array(["".join(map(str, v)) for _, v in keys]),
                                                  pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "votes", "n"])

    seen = ship(docs).select(text_col).mapInArrow(run, "kind string, votes string, n long")
    return seen.groupBy("kind", "votes").agg(F.sum("n").alias("n"))


@dataclass
class Classifier:
    """EM's estimates (by kind: prior, reliabilities[class, labeler, vote]) and the regression's weights by kind."""

    reliabilities: dict
    weights: dict

    def probability(self, kind: str, pattern: tuple[int, ...]) -> float:
        if kind not in self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(_features(np.array([pattern])) @ self.weights[kind], -30, 30)))[0])


def _features(v: np.ndarray) -> np.ndarray:
    n = len(LABELERS)
    return np.column_stack([np.ones(len(v)), *(v[:, k] == x for k in range(n) for x in (1, 2)),
                            *(v[:, n] == x for x in range(len(LENGTHS) + 1))]).astype(float)


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of each pattern, share of true candidates, and reliabilities [class, labeler, vote]."""
    k = len(LABELERS)
    v = v[:, :k]
    yes, no = (v == 1).sum(1), (v == 2).sum(1)
    post = np.where(yes > no, 0.9, np.where(yes == no, 0.5, 0.1))
    for _ in range(rounds):
        prior = ((post * n).sum() + 1) / (n.sum() + 2)
        table = np.empty((2, k, 3))
        for c, p in enumerate((1 - post, post)):
            for x in range(3):
                table[c, :, x] = (((v == x) * (p * n)[:, None]).sum(0) + 1) / ((p * n).sum() + 3)
        like = [np.log(q) + np.log(table[c, np.arange(k), v]).sum(1) for c, q in enumerate((1 - prior, prior))]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, prior, table


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted logistic regression on soft labels, small ridge, Newton's method."""
    w, ridge = np.zeros(x.shape[1]), 0.1
    n = n / max(1.0, n.sum()) * min(n.sum(), 1e5)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, text_col: str = "text") -> Classifier:
    """Reliabilities and classifier from the votes over all of ``docs``; at most 4 * 3**6 * 7 pattern counts reach the driver."""
    rows = sorted((r["kind"], r["votes"], r["n"]) for r in vote_table(docs, text_col).collect())
    reliabilities, weights = {}, {}
    for kind in KINDS:
        own = [(v, n) for k, v, n in rows if k == kind]
        if own:
            v, n = np.array([[int(c) for c in p] for p, _ in own]), np.array([n for _, n in own], float)
            post, prior, table = expectation_maximisation(v, n)
            reliabilities[kind] = prior, table
            weights[kind] = _fit(_features(v), post, n)
    return Classifier(reliabilities, weights)


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, classifier: Classifier, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with ``base`` and ``spans``: arrays of kind, start, end."""
    keep = [f for f in docs.schema.fields if f.name not in ("base", "spans") and (keep_text or f.name != text_col)]
    spans = T._parse_datatype_string(_SPANS)
    schema = T.StructType([*keep, T.StructField("base", spans), T.StructField("spans", spans)])
    names, order = schema.names, {k: i for i, k in enumerate(KINDS)}

    def run(batches):
        known: dict = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                bases, alls = [], []
                for text in part.column(text_col):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    more = []
                    for kind, a, b, v in candidates(text, base):
                        if v[0] == 2:
                            if (kind, v) not in known:
                                known[kind, v] = classifier.probability(kind, v) >= ACCEPT
                            if known[kind, v]:
                                more.append((kind, a, b))
                    bases.append(base)
                    alls.append(sorted([*base, *more], key=lambda s: (order[s[0]], s[1], s[2])))
                rows = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in y], _ARROW_SPANS) for y in (bases, alls)]
                cols = dict(zip(("base", "spans"), rows))
                yield pa.RecordBatch.from_arrays([cols[n] if n in cols else part.column(n) for n in names], names=names)

    return ship(docs).mapInArrow(run, schema)
