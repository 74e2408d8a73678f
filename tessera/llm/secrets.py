"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are runs of token characters that are long and mixed, runs that stand right after an
assignment to a name such as `token` or `password`, and private-key blocks to their last line, headers included. Each gets features: its length, classes of
characters and transitions between them, how well its letters follow each other as in words, how
much of it the dictionary covers, whether it looks like a path, and words before and after it. A
random forest trained from labelled findings gives the probability that it is a secret.

`fit` takes labelled findings (text, start, end, label); by default it trains from `labelled`,
which makes findings of both kinds from templates with a fixed seed, as no labelled table exists.

Defined results: null and empty texts, and tables without rows, have no findings. Whole texts are read; a candidate may be of
any length, and features are those of all of it. Repeated candidates in a text, and repeated rows, are repeated findings. Null ids stay null. Offsets count code points.
findings() takes doc_id and text alone; with redact() other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
import uuid as uuids
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .blocks import BLOCK, prepare, runs, slices

#: Words that name secrets, words that mark digests or placeholders, endings of file names, and the dictionary.
SECRET_WORDS = "apikey auth authorization bearer cert client credential credentials key passphrase passwd password private pwd secret token".split()
DIGEST_WORDS = "blob build checksum commit digest etag fingerprint guid hash id integrity md5 revision sha sha1 sha256 sha512 uuid version".split()
PLACEHOLDERS = "changeme demo dummy example fake foo lorem placeholder redacted sample test todo xxx your".split()
ENDINGS = "css gif html java jpeg jpg js json md pdf php png py svg ts txt xml yaml yml".split()
DICTIONARY = (
    "about access account action active add address admin after agent all allow also alpha and any api app apply array auth auto back base beta between block body book bool buffer build button by byte cache call cancel case change char check child class clean clear client clock close code column command comment commit common config connect content context control copy core count create current data date debug default delete demo design detail device direct disable display do document domain down edit element email empty enable end entity entry error event example exit export factory false field file filter final find first flag float font for form format found from function future get global go group guide handle handler has hash header height help hidden home host hour html http id if image import in index info init input insert int interface internal into is item job join json key label language last layer layout left length level library license line link list load local lock log login long lower main make manager map mask match max media member memory menu merge message method min mode model module month more mouse move name native new next no node not null number object of off offset old on open option or order other out output override package page parent parse part pass path pattern phone pixel place play plugin point pool port position post press print private process profile project property protocol provider proxy public query queue random range read record region release remove render replace report request reset resource response result return right role root route row rule run safe sample save scale schema scope screen script search section select send sequence server service session set shape share short show sign simple single size slot sort source space split stack start state static status step stop storage store stream string style submit summary support switch system tab table tag target task template test text theme this thread time title to token tool total trace track tree true type under union unit unique update upload url use user util value variable vector version video view visible wait was web when width window with word work worker world write year zone"
).split()
_DICTIONARY = {w for w in DICTIONARY if len(w) > 2}

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), ord("+"), ord("/"), ord("_"), ord("-")]] = True
_KIND = np.zeros(256, np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3
_BEFORE, _AFTER = 64, 32
_ASSIGNED = re.compile(rb"([\w.\-]{1,64})[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}[\"'`]?$")
_NAMES = re.compile("|".join(SECRET_WORDS).encode(), re.I)
_PEM = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----")
#: What follows a block's first line where its last one is missing: headers, and lines of base64.
_PEM_LINES = re.compile(rb"(?:(?:\s|\\[nr])*(?:[A-Za-z][\w-]{0,40}: [^\n]*|[A-Za-z0-9+/=]{16,}))*")
_WORD = re.compile(r"[a-z]+")
#: Forms of well-known issuers.
KINDS = [("aws_key", r"(?:AKIA|ASIA)[0-9A-Z]{16}"), ("github_token", r"gh[pousr]_\w{36,}"), ("slack_token", r"xox[abprs]-[\w-]{10,}"), ("google_key", r"AIza[\w-]{35}"), ("stripe_key", r"[rs]k_(?:live|test)_\w{16,}"), ("jwt", r"eyJ[\w-]{10,}.*")]
_KINDS = [(k, re.compile(p)) for k, p in KINDS]


def private_keys(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of private-key blocks: to the last line of the same name, if no other block begins before it."""
    marks = list(_PEM.finditer(data))
    out = []
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        if m[1] == b"BEGIN":
            whole = after is not None and after[1] == b"END" and after[2] == m[2]
            out.append((m.start(), after.end() if whole else _PEM_LINES.match(data, m.end()).end()))
    return out


def candidates(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of candidates, in order. Blocks of bytes are searched; a run is never cut."""
    found, at, x = [], 0, np.frombuffer(data, np.uint8)
    while at < len(x):
        end = min(at + BLOCK, len(x))
        while end < len(x) and _RUN[x[end - 1]] and _RUN[x[end]]:
            rest = np.flatnonzero(~_RUN[x[end : end + BLOCK]])
            end += int(rest[0]) if len(rest) else len(x[end : end + BLOCK])
        piece = x[at:end]
        s, e = runs(piece, _RUN[piece])
        s, e = s[(n := e - s) >= 8], e[n >= 8]
        kind = _KIND[piece]
        digits = np.concatenate([[0], np.cumsum(kind == 1)])
        cased = np.concatenate([[0], np.cumsum((kind[1:] == 2) & (kind[:-1] == 3))]) if len(kind) > 1 else np.zeros(2, int)
        has_digit, up = digits[e] - digits[s] > 0, cased[np.minimum(e - 1, len(cased) - 1)] - cased[s]
        letters = digits[e] - digits[s] < e - s
        assigned = (s + at > 0) & np.isin(x[np.maximum(s + at - 1, 0)], np.frombuffer(b"\"'`=: ", np.uint8))
        for a, b, mixed, maybe in zip(s + at, e + at, ((has_digit & letters & (e - s >= 16)) | ((up >= 3) & (e - s >= 20))).tolist(), assigned.tolist(), strict=True):
            a, b = int(a), int(b)
            if not mixed:
                if not maybe or data[a - 1] == 32 and (a < 3 or data[a - 2] not in b"=:"):
                    continue
                m = _ASSIGNED.search(data[max(0, a - 72) : a])
                if not m or not _NAMES.search(m[1]):
                    continue
            if data[a : a + 3] == b"eyJ" and data[b : b + 1] == b".":
                while b < len(data) and (data[b] == 46 or _RUN[data[b]]):
                    b += 1
            found.append((a, b))
        at = end
    pem = private_keys(data) if b"PRIVATE KEY" in data else []
    if pem:
        first = np.array([a for a, _ in pem])
        inside = lambda a: (k := int(np.searchsorted(first, a, "right")) - 1) >= 0 and a < pem[k][1]
        found = sorted([c for c in found if not inside(c[0])] + pem)
    out, last = [], -1
    for a, b in found:
        if a >= last:
            out.append((a, b))
            last = b
    return out


#: How English-like a pair of letters is: logarithms from the dictionary's own pairs.
_COUNTS = Counter(w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1))
_PAIRS = np.log((np.array([[_COUNTS[chr(a) + chr(b)] for b in range(97, 123)] for a in range(97, 123)]) + 0.5) / sum(_COUNTS.values()))
#: Classes of bytes: 1 digits, 2 capitals, 3 small letters, 0 all else; and letters by number, 26 for all else.
_LETTER = np.full(256, 26, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(26)


def features(value: str, before: str, after: str) -> list[float]:
    """A candidate's features, over all of its UTF-8 bytes; before and after are the text around it."""
    data = np.frombuffer(value.encode(errors="replace"), np.uint8)
    n = len(data)
    kinds = _KIND[data]
    share = np.bincount(kinds, minlength=4) / n
    counts = np.bincount(data)
    counts = counts[counts > 0] / n
    letter = _LETTER[data]
    both = (letter[1:] < 26) & (letter[:-1] < 26)
    pairs = _PAIRS[letter[:-1][both], letter[1:][both]]
    low = value.lower()
    words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    covered = sum(len(w) for w in words if w in _DICTIONARY)
    near = before.lower()
    words_near, words_after = set(_WORD.findall(near)), set(_WORD.findall(after.lower()))
    assigned = _ASSIGNED.search(before.encode())
    name = assigned[1].decode(errors="replace").lower() if assigned else ""
    steps = np.abs(np.diff(data.astype(np.int16))) <= 1
    return [
        float(n),
        float(n in (32, 40, 64)),
        float(share[1]),
        float(share[2]),
        float(share[3]),
        float(share[0]),
        float((kinds[1:] != kinds[:-1]).sum() / n),
        float(-(counts * np.log2(counts)).sum()),
        float(counts.max()),
        float(not low.strip("0123456789abcdef-")),
        float(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low) is not None),
        float(pairs.mean()) if len(pairs) else -9.0,
        covered / n,
        max(map(len, words), default=0) / n,
        value.count("/") / n,
        float(bool(re.match(r"\.(" + "|".join(ENDINGS) + r")\b", after))),
        float(before[-1:] in ("/", "\\", ".") or "://" in before[-40:].split(" ")[-1]),
        float(bool(assigned)),
        float(any(w in name for w in SECRET_WORDS)),
        float(any(w in words_near for w in SECRET_WORDS)),
        float(any(w in DIGEST_WORDS for w in re.findall(r"[a-z]+\d*", name))),
        float(any(w in words_near or w in words_after for w in DIGEST_WORDS)),
        float(any(w in low or w in words_near for w in PLACEHOLDERS)),
        float(any(p.match(value) is not None for _, p in _KINDS) or value.startswith("-----BEGIN")),
        float(steps.mean()) if n > 1 else 0.0,
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(after)),
    ]


def labelled(n: int = 6000, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """n labelled findings (text, start, end, label), half of them secrets, from templates."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    vowels, consonants = "aeiouy", "bcdfghklmnprstvw"
    word = lambda: r.choice(DICTIONARY) if r.random() < 0.4 else "".join(r.choice(consonants) + r.choice(vowels) for _ in range(r.randint(1, 4))) + r.choice(["", "n", "s", "er", "ing"])
    prose = lambda k: " ".join(word() for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"

    def key_block(kind: str) -> str:
        name = kind + "PRIVATE KEY" + (" BLOCK" if kind == "PGP " else "")
        head = r.choice(["", "", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + some(hexa.upper(), 32) + "\n\n"])
        return f"-----BEGIN {name}-----\n{head}" + "\n".join(some(alnum + "+/", 64) for _ in range(r.randint(0, 6))) + "\n" + some(alnum, r.randint(3, 40)) + f"=\n-----END {name}-----"

    def secret() -> str:
        return r.choice(
            [
                lambda: some(hexa, r.choice([32, 40, 40, 48, 64])), lambda: some(alnum, r.randint(16, 64)), lambda: base64.b64encode(r.randbytes(r.randint(15, 48))).decode().rstrip("="),
                lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + some(alnum, 36), lambda: "xoxb-" + some(string.digits, 12) + "-" + some(alnum, 24), lambda: "AIza" + some(alnum + "-_", 35), lambda: "sk_live_" + some(alnum, 24),
                lambda: "eyJ" + some(alnum, 20) + "." + some(alnum, 40) + "." + some(alnum + "-_", 43), lambda: some(alnum, r.randint(8, 14)) + r.choice("0123456789"),
                lambda: key_block(r.choice(["", "RSA ", "EC ", "ENCRYPTED ", "PGP "])),
            ]
        )()

    def around(value: str) -> tuple[str, str]:
        name = r.choice([r.choice(SECRET_WORDS), word() + "_" + r.choice(SECRET_WORDS), r.choice(["api_key", "access_token", "secret_key", "db_password", "auth_token", "API_KEY", "SECRET", "Token"])])
        q = r.choice(['"', "'", "", '"'])
        form = r.randrange(5)
        if value.startswith("-----") and form:
            return r.choice(["", prose(3) + "\n"]), r.choice(["", "\n" + prose(3)])
        if form == 4 and len(value) >= 20:
            return r.choice(["Authorization: Bearer ", "the key is ", "use token ", "login with secret "]), " " + prose(2)
        return prose(r.randint(0, 6)) + " " + name + r.choice([" = ", "=", ": ", '": ', " := "]) + q, q + r.choice([" ", "\n", "", ";", "### "]) + prose(r.randint(0, 4))

    def harmless() -> tuple[str, str, str]:
        return r.choice(
            [
                lambda: (r.choice(["commit ", "sha1 = ", "checksum: ", "md5: ", "digest ", "revision ", 'integrity="sha256-', "blob ", 'etag: "']), some(hexa, r.choice([32, 40, 40, 64])), " " + prose(3)),
                lambda: (r.choice(["id ", "uuid: ", "request ", 'guid = "', "session "]), str(uuids.UUID(int=r.getrandbits(128))), " " + prose(2)),
                lambda: (r.choice(["api_key = ", "password: ", 'token = "', "secret="]), r.choice(["your_api_key_here1", "example_token_12345", "changeme12345678", "xxxxxxxxxxxxxxxx1", "placeholder_value_0", "test_password_123", "dummy-secret-0001"]), '"'),
                lambda: (prose(3) + " ", "".join(r.choice(DICTIONARY).title() for _ in range(r.randint(4, 7))) + some("0123456789", r.randint(0, 2)), "(" + word() + ")"),
                lambda: (prose(3) + " ", "_".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + "_" + some("0123456789", r.randint(1, 3)), " = " + word()),
                lambda: (r.choice(["https://", "see http://", "file:///"]) + word() + r.choice([".com/", ".org/"]), "/".join(word() for _ in range(r.randint(2, 5))) + "/" + some("0123456789", 4), "." + r.choice(ENDINGS)),
                lambda: (r.choice(["src/", "in /", "path: /"]), "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + some("0123456789", 2), "." + r.choice(ENDINGS)),
                lambda: (r.choice(["image/png;base64,", "data:font/woff;base64,"]), base64.b64encode(r.randbytes(r.randint(60, 400))).decode().rstrip("="), '")'),
                lambda: (prose(4) + " ", word() + word() + word() + some("0123456789", r.randint(1, 4)), " " + prose(4)),
                lambda: (prose(2) + r.choice([" call ", " phone ", " on ", " "]), r.choice(["2021-03-04T10-11-12", "1-800-555-0199-ext", "0123456789abcdef", "abcdefghijklmnop1", "AAAAAAAAAAAAAAAA1", "1234567890123456a"]), " " + prose(2)),
                lambda: (r.choice(["password: ", "token = ", "key: ", 'secret_name: "']), "-".join(r.choice(DICTIONARY) for _ in range(3)), " " + prose(2)),
            ]
        )()

    out = []
    for i in range(n):
        if i % 2:
            before, after = around(value := secret())
        else:
            before, value, after = harmless()
        out.append((before + value + after, len(before), len(before) + len(value), i % 2))
    return out


@dataclass
class Forest:
    """Trees as arrays over their nodes: the feature (-1: a leaf), the threshold, the children, the share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, child, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                go = child[at[inner]] + (x[inner, feature[at[inner]]] > threshold[at[inner]])
                at[inner] = go
            total += share[at]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 4, seed: int = 3) -> Forest:
    """A random forest: each tree from a bootstrap sample, each split the best Gini gain among a random third of the features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        own = rng.integers(0, len(x), len(x))
        feature, threshold, child, share = [-1], [0.0], [0], [0.0]
        todo = [(0, own, 0)]
        while todo:
            node, rows, level = todo.pop()
            share[node] = float(y[rows].mean())
            if level == depth or len(rows) < 2 * least or share[node] in (0.0, 1.0):
                continue
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                v = x[rows, f]
                order = np.argsort(v, kind="stable")
                v, t = v[order], np.cumsum(y[rows][order])
                k = np.arange(1, len(v))
                ok = (v[1:] > v[:-1]) & (k >= least) & (len(v) - k >= least)
                if not ok.any():
                    continue
                left, right = t[:-1] / k, (t[-1] - t[:-1]) / (len(v) - k)
                p = t[-1] / len(v)
                gain = np.where(ok, p * (1 - p) - (k * left * (1 - left) + (len(v) - k) * right * (1 - right)) / len(v), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
            if best[1] < 0:
                continue
            feature[node], threshold[node], child[node] = best[1], best[2], len(feature)
            goes = x[rows, best[1]] > best[2]
            for side in (rows[~goes], rows[goes]):
                todo.append((len(feature), side, level + 1))
                feature.append(-1)
                threshold.append(0.0)
                child.append(0)
                share.append(0.0)
        out.append((np.array(feature), np.array(threshold), np.array(child), np.array(share)))
    return Forest(out)


def fit(findings: list[tuple[str, int, int, int]] | None = None) -> Forest:
    findings = labelled() if findings is None else findings
    x = np.array([features(t[a:b], t[max(0, a - _BEFORE) : a], t[b : b + _AFTER]) for t, a, b, _ in findings])
    return grow(x, np.array([y for *_, y in findings], float))


def scan(text: str | None, forest: Forest) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, probability) of each candidate in a text; offsets in code points."""
    if not text:
        return []
    data = text.encode(errors="replace")
    spans = candidates(data)
    if not spans:
        return []
    rows, out, chars, done = [], [], 0, 0
    for a, b in spans:
        value = data[a:b].decode(errors="replace")
        before, after = data[max(0, a - _BEFORE) : a].decode(errors="ignore"), data[b : b + _AFTER].decode(errors="ignore")
        rows.append(features(value, before, after))
        kind = "private_key" if value.startswith("-----BEGIN") else next((k for k, p in _KINDS if p.match(value)), "assigned" if rows[-1][18] else "mixed")
        start = chars + len(data[done:a].decode(errors="replace"))
        out.append((start, start + len(value), kind))
        chars, done = start + len(value), b
    return [(*x, float(p)) for x, p in zip(out, forest.predict(np.array(rows)), strict=True)]


#: A finding is a secret from this probability on.
SURE = 0.5


def findings(docs: DataFrame, forest: Forest, sure: float = SURE) -> DataFrame:
    """One row (doc_id, start, end, kind, score, is_secret, sha256 of the candidate) for each candidate in each text."""
    prepare(docs.sparkSession)

    def find(batches):
        for part, texts in slices(batches, "text"):
            got = [(i, s, e, kind, p, p >= sure, hashlib.sha256(t[s:e].encode()).hexdigest()) for i, t in zip(part.column(0).to_pylist(), texts, strict=True) for s, e, kind, p in scan(t, forest)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(got, columns=["doc_id", "start", "end", "kind", "score", "is_secret", "sha256"]), schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64()), ("is_secret", pa.bool_()), ("sha256", pa.string())]), preserve_index=False)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, start long, end long, kind string, score double, is_secret boolean, sha256 string")


def redact(docs: DataFrame, forest: Forest, mark: str = "[secret]", sure: float = SURE) -> DataFrame:
    """The rows with each secret in text replaced by mark. Texts without secrets, and nulls, stay as they are."""
    prepare(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        for s, e, _, p in reversed(scan(text, forest)):
            if p >= sure:
                text = text[:s] + mark + text[e:]
        return text

    @F.pandas_udf(StringType())
    def cleaned(text: pd.Series) -> pd.Series:
        return pd.Series([clean(t) for t in text], dtype=object)

    return docs.withColumn("text", cleaned("text"))
