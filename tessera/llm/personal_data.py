"""Personal data: exact base patterns, and further spans by weak supervision."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can't begin within a run of digits: if it failed at the run's start, it fails there too
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

#: What may be personal data: numbers with separators, and addresses written out.
LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,23}(?![0-9A-Za-z])")
LOOSE_MAIL = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{2,63}){1,6}")

# Word lists of the labelers.
MAIL_ENDINGS = frozenset("com org net edu gov info biz io eu uk us de fr es it nl ch at be pt pl se dk no fi ie ca au".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
ISSUERS = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65")
CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel".split()),
    "ip": frozenset("ip host server address addr adresse address:".split()),
    "card": frozenset("card visa mastercard credit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call fax mobile telefon téléphone teléfono".split()),
}
DECOYS = frozenset("version v isbn issn page chapter section article order invoice rfc no no. number id doi seite kapitel página".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the local characters before it, and a domain after it. The local class holds no @, so the run before is the leftmost match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed. Matches that fail their test are dropped and not tried again."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Loose matches and the kind each would be."""
    for m in LOOSE_NUMBER.finditer(text):
        s = m[0]
        n = sum(c.isdigit() for c in s)
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s):
            yield m.start(), m.end(), "ip"
        elif n >= 13 and s[0] != "+":
            yield m.start(), m.end(), "card"
        elif n <= 15:
            yield m.start(), m.end(), "phone"
    if "@" in text or "(at)" in text or "[at]" in text:
        for m in LOOSE_MAIL.finditer(text):
            yield m.start(), m.end(), "email"


def votes(text: str, start: int, end: int, kind: str) -> list[int]:
    """What each labeler says of a candidate: 1 personal, -1 not, 0 nothing. Two regex labelers, two gazetteers, two of context."""
    s = text[start:end]
    digits = NOT_DIGITS.sub("", s)
    before = text[max(0, start - 48) : start].lower().split()[-5:]
    parts = re.split(r"[.]", s)
    if kind == "email":
        shape = 1 if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s) else 0
        rule = 1 if len(parts[-1].strip(" )]")) >= 2 else -1
        known = 1 if re.split(r"[\s.\])]+", s)[-1].lower() in MAIL_ENDINGS else 0
    elif kind == "ip":
        ok = all(len(p) <= 3 and int(p) <= 255 for p in parts)
        shape = 1 if ok and all(len(p) > 1 for p in parts[:2]) else 0
        rule = 1 if ok else -1
        known = -1 if parts[0] in ("0", "00", "127", "255") else 0
    elif kind == "card":
        shape = 1 if re.fullmatch(r"[0-9]{16}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{15}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", s) else -1
        rule = 1 if luhn(digits) else -1
        known = 1 if digits.startswith(ISSUERS) else -1
    else:
        shape = 1 if re.fullmatch(r"\+[0-9]{1,3}[ .-]?(\([0-9]{1,4}\))?[0-9 .-]+|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s) else -1
        rule = 1 if 10 <= len(digits) <= 13 else -1 if len(digits) < 9 else 0
        known = (1 if digits.startswith(CALLING_CODES) else -1) if s[0] == "+" else 0
    decoy = -1 if before and before[-1].strip(":#(") in DECOYS else 0
    cue = 1 if any(w.strip(":.,(") in CUES[kind] for w in before) else 0
    around = text[start - 1 : start] + text[end : end + 1]
    edge = -1 if any(c.isalnum() or c in '=_"/#' for c in around) else 1
    return [shape, rule, known, decoy, cue, edge]


def key_of(text: str, start: int, end: int, kind: str) -> str:
    """A candidate's kind, votes and coarse form. Few values are possible, so counts by key are bounded whatever the input's size."""
    s = text[start:end]
    n = sum(c.isdigit() for c in s)
    form = f"{sum(n >= k for k in (9, 13, 16, 17))}{sum(sum(not c.isalnum() for c in s) >= k for k in (1, 3))}"
    return f"{kind}:{''.join('-0+'[v + 1] for v in votes(text, start, end, kind))}:{form}"


def reliabilities(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """The chance that candidates of each key are personal data, by expectation-maximisation.

    Given the truth, labelers vote independently; each has, for each kind and truth, its own chances to say yes, no or
    nothing (so a checksum that any tenth number passes is known as such). Starts from each pattern's share of yes
    among what was said; chances are smoothed towards labelers that are right four times in five.
    """
    out: dict[str, float] = {}
    for kind in KINDS:
        keys = sorted(k for k in counts if k.startswith(f"{kind}:"))
        if not keys:
            continue
        v = np.array([["-0+".index(c) for c in k.split(":")[1]] for k in keys])
        n = np.array([counts[k] for k in keys], float)
        said = np.eye(3)[v]  # key, labeler, vote
        yes, no = (v == 2).sum(1), (v == 0).sum(1)
        p = np.clip((yes + 0.2) / (yes + no + 0.4), 0.05, 0.95)
        right = np.array([[1.6, 0.4, 0.4], [0.4, 0.4, 1.6]])  # pseudo-counts by truth and vote
        for _ in range(rounds):
            weight = np.stack([n * (1 - p), n * p])
            chance = np.einsum("yk,klv->ylv", weight, said) + right[:, None, :]
            chance /= chance.sum(2, keepdims=True)
            prior = (weight.sum(1) + 1) / (n.sum() + 2)
            log = np.log(prior)[:, None] + np.einsum("klv,ylv->yk", said, np.log(chance))
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        out |= dict(zip(keys, p.tolist(), strict=True))
    return out


def parts_of(key: str) -> list[str]:
    """The classifier's features: each vote within its kind, and the form within it."""
    kind, v, form = key.split(":")
    return [kind, *(f"{kind}{i}{c}" for i, c in enumerate(v)), f"{kind}n{form[0]}", f"{kind}s{form[1]}"]


def train(counts: dict[str, int], soft: dict[str, float], steps: int = 400) -> dict[str, float]:
    """The final span classifier: a logistic regression on soft labels, given as its value for each key seen."""
    keys = sorted(counts)
    if not keys:
        return {}
    names = {f: i for i, f in enumerate(sorted({f for k in keys for f in parts_of(k)}))}
    x = np.zeros((len(keys), len(names)))
    for i, k in enumerate(keys):
        x[i, [names[f] for f in parts_of(k)]] = 1
    n = np.sqrt(np.array([counts[k] for k in keys], float))  # frequent forms shouldn't drown the rest
    n /= n.sum()
    y, w = np.array([soft[k] for k in keys]), np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (n * (p - y)) + 1e-4 * w)
    return dict(zip(keys, (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


SCANNED = "n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:int,end:int,kind:string>>, loose array<struct<start:int,end:int,kind:string,key:string>>"


def scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Base spans and candidates of every whole text; one pass."""
    from pyspark.sql import types as T

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    loose_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("key", pa.string())]))

    def one(t: str | None):
        if not t:
            return [], []
        base = base_spans(t)
        loose = []
        for a, b, kind in candidates(t):
            loose.append({"start": a, "end": b, "kind": kind, "key": key_of(t, a, b, kind)})
        return [{"start": a, "end": b, "kind": kind} for a, b, kind in base], loose

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = [one(t) for t in b.column(text).to_pylist()]
                tally = [Counter(s["kind"] for s in base) for base, _ in found]
                numbers = [pa.array([c[k] for c in tally], pa.int64()) for k in KINDS]
                arrays = [pa.array([x for x, _ in found], span), pa.array([x for _, x in found], loose_span)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *numbers, *arrays], [*keep, *(f"n_{k}" for k in KINDS), "base", "loose"])

    added = docs.sparkSession.createDataFrame([], SCANNED).schema
    fields = [f for f in docs.schema.fields if f.name in keep]
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([*fields, *added.fields]))


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.8) -> DataFrame:
    """Base spans of every text, and what weak supervision adds.

    Regex, gazetteer and context labelers vote on loose candidates in the whole corpus; expectation-maximisation on
    the counts of vote patterns (bounded in number) estimates their reliabilities and gives soft labels; a logistic
    span classifier trained on those decides. A candidate it takes is added where it overlaps no base span; base spans
    always stay. Columns: `keep`, n_email, n_ip, n_card, n_phone (base spans), base, spans (all; arrays of structs by
    start, then kind). Null and empty texts have none. Repeated rows get the same answer.
    """
    from tessera.llm.common import Scratch

    scanned = Scratch(docs.sparkSession).save(scan(docs, text, list(keep)), "spans")
    counts = {r["key"]: r["count"] for r in scanned.select(F.explode("loose.key").alias("key")).groupBy("key").count().collect()}
    sure = train(counts, reliabilities(counts))
    taken = F.array(*[F.lit(k) for k in sorted(k for k, p in sure.items() if p >= threshold)]).cast("array<string>")
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter("loose", lambda c: F.array_contains(taken, c["key"]) & free(c))
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(F.concat("base", F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))),
                                       lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return scanned.select(*keep, *(f"n_{k}" for k in KINDS), "base", spans.alias("spans"))


def listed(spans: str) -> F.Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
