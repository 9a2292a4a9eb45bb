"""Secret scan: candidates by expressions, false positives removed by a random forest.

Candidates are (a) values assigned to names like password or token, whole when in quotes, (b) key ids of a known form and (c) long unbroken
runs that mix letters and digits. Each is judged on its length, character transitions, share of digits, entropy,
dictionary coverage (share of its letters inside plain or placeholder words), path signs around it and the
neighbouring words. The forest is trained from labelled findings, which are a parameter: labelled_findings() makes a
bounded, seeded set of credentials in their public forms against placeholders, digests, ids, versions and paths.

A text that no JVM-side expression marks never reaches Python. Spans count code points.

Cases: a null or empty text has no findings; null ids pass through; repeated rows give repeated findings; a very long
text is scanned whole; an empty table gives no rows; extra columns are ignored (in `redact` they are kept).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import lowered
from .common import clear_name, pieces, plain_schema
from .trees import Forest
from .urls import entropy

# fixed values: names that credentials are assigned to, words of placeholders
NAMES = "token password passwd pwd secret api_key apikey api-key access_key access-key auth_token private_key client_secret bearer".split()
COMMON = (
    "about account action active after again agent alpha amount animal apple archive around array author banana basic beach before better binary black block bottle bridge bright "
    "bucket buffer build button cache camera castle center change channel charge check circle class client cloud coffee color column common config connect content control cookie copper "
    "count country cover create custom daily data database deploy design detail device digital direct document dollar domain door double dragon driver east email empty engine entry "
    "error event every example express family field file filter final first flower folder forest format frame friend front garden general global gold green group happy header hello "
    "house image index input island item kernel layer letter level light local login magic manager market master memory message method middle mobile model module monkey month mountain "
    "music name network never night north number object ocean office online open option orange order other output owner package page paper parent party path people phone picture "
    "plain planet platform player point power press price print private process product profile project public query queue quick random reader record region release remote report request "
    "resource result return review river road root school science script search season second server service session shadow share silver simple single socket source south space "
    "special spring square start state static station status stone store story stream street string student studio style summer sunshine super support switch system table target task "
    "team template thread tiger time title today tower travel tree type union unit update upload user value video view visitor water weather west white window winter world yellow"
).split()
DUMMY = "your example changeme placeholder dummy sample test none null true false password secret token here default insert redacted version".split()
NEAR = NAMES + "aws login credential authorization header export config env".split()
AWAY = "commit sha sha1 sha256 md5 checksum digest hash revision uuid guid version isbn order build file path image id".split()

KEY_ID = re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])")
#: Dotted runs, in which a web token is looked for; whole runs, so that no text is gone over again and again.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10}")
#: A name, perhaps in quotes or brackets, and a sign (bearer: or a blank); then the whole value in quotes of a line, else
#: up to white space, a closing quote or the next parameter of a query.
NAMED = r"(?:" + "|".join(sorted(map(re.escape, NAMES), key=len, reverse=True)) + r")(?:\\?[\"'`])?\]?[ \t]*+(?:[=:]|=>|:=)|bearer[ \t]"
ASSIGNED = re.compile(
    r"(?i)(?:" + NAMED + r")[=>]*+[ \t]*+(?:"
    r"\\([\"'])(?P<a>(?:(?!\\?[\"'])[^\n])+)\\\1"
    r"|\"(?P<b>(?:\\.|[^\"\\\n])++)\"|'(?P<c>(?:\\.|[^'\\\n])++)'|`(?P<d>[^`\n]++)`"
    r"|(?:\\?[\"'`])?(?P<e>(?:(?!\\?[\"'`](?:[\s,;:)\]}>]|\Z)|&[A-Za-z_][\w.-]{0,63}=)\S)++))"
)
RUN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+(?!@)")
#: What marks a text for Python, as the JVM sees it.
MARK = r"(?i)" + NAMED + r"|(?:akia|asia)[0-9a-z]{16}|gh[pousr]_[a-z0-9]{36}|xox[abpr]-|eyj[a-z0-9_-]{10}|(?<![a-z0-9_+/-])(?=[a-z_+/-]*+[0-9])[a-z0-9_+/-]{20}"


def key_ids(text: str) -> list[tuple[int, int]]:
    """Spans of key ids; of a web token all segments of ten characters or more, whatever their length."""
    out = [m.span(1) for m in KEY_ID.finditer(text)]
    for run in DOTTED.finditer(text) if "eyJ" in text else ():
        at, begin, n = run.start(), None, 0
        for part in [*run[0].split("."), ""]:
            if begin is not None and len(part) >= 10:
                n += 1
            else:
                if n > 1:
                    out.append((begin, at - 1))
                m = WEB_TOKEN.search(part)
                begin, n = (at + m.start() if m else None), 0
            at += len(part) + 1
    return sorted(out)


def mixed(value: str) -> bool:
    """Whether letters and digits are both there."""
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value))


def values(text: str) -> list[tuple[int, int]]:
    """Spans of assigned values of six characters or more; bare ones without the punctuation that ends a phrase."""
    out = []
    for m in ASSIGNED.finditer(text):
        a, b = m.span(m.lastgroup)
        if m.lastgroup == "e":
            depth = {c: m["e"].count(o) - m["e"].count(c) for o, c in ("()", "[]", "{}", "<>")}
            while b > a and (text[b - 1] in ".,;:" or depth.get(text[b - 1], 0) < 0):
                b -= 1
                depth[text[b]] = depth.get(text[b], 0) + 1
        if b - a >= 6:
            out.append((a, b))
    return out


def nested(text: str) -> list[tuple[int, int, str, list[tuple[int, int, str]]]]:
    """(start, end, kind, inner) of non-overlapping candidates: assigned values with the key ids and runs inside them,
    other key ids, then other runs."""
    keys = key_ids(text)
    same = set(keys)
    out = [(a, b, "assigned", []) for a, b in values(text) if (a, b) not in same]
    for kind, spans in (("key_id", keys), ("run", [m.span() for m in RUN.finditer(text) if mixed(m[0])])):
        out.sort()
        taken, starts = list(out), [t[0] for t in out]
        for a, b in spans:
            i = bisect_left(starts, b)
            if i == 0 or taken[i - 1][1] <= a:
                out.append((a, b, kind, []))
            elif taken[i - 1][2] == "assigned" and taken[i - 1][0] <= a and b <= taken[i - 1][1] and (a, b) != taken[i - 1][:2]:
                taken[i - 1][3].append((a, b, kind))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of non-overlapping candidates."""
    return [c[:3] for c in nested(text)]


_KIND = np.full(128, 3)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 24]
    codes = _KIND[np.minimum(np.frombuffer(value.encode("utf-32-le"), np.uint32), 127)]
    n = len(value)
    low = lowered(value)
    covered = np.zeros(n, bool)
    for w in _DICTIONARY.finditer(low):
        covered[w.start() : w.end()] = True
    words = re.findall(r"[a-z_0-9-]+", lowered(before))[-3:]
    near = sum(any(x in w for x in NEAR) for w in words)
    away = sum(w in AWAY for w in words)
    path = value.count("/") + value.count(".") + bool(re.match(r"\.(?:html?|png|jpg|py|js|json|txt)|[/.]", after)) + before.endswith(("/", "//", "www."))
    shares = np.bincount(codes, minlength=4) / n
    formula = sum(value.count(c) for c in "${}()<>[]") / n  # a template or a call
    name = float(bool(re.fullmatch(r"[A-Za-z_]+(?:[._-][A-Za-z_]+)*", value)))  # an identifier
    hexed = float(bool(re.fullmatch(r"[0-9a-fA-F]+", value)))
    return [n, float((codes[1:] != codes[:-1]).mean()) if n > 1 else 0.0, *shares.tolist(), entropy(value), len(set(value)) / n, float(covered.mean()), path, near, away, hexed, float(value.startswith(("AKIA", "ASIA", "ghp_", "xox", "eyJ"))), float(kind == "assigned"), float(before[-1:] in "\"'="), float("EXAMPLE" in value.upper()), formula, name]


_DICTIONARY = re.compile("|".join(sorted({w for w in COMMON + DUMMY if len(w) > 3}, key=len, reverse=True)))


def labelled_findings(n: int = 4000, seed: int = 3) -> list[tuple[str, int]]:
    """Texts with one candidate each (the marked one, between \x02 and \x03) and labels (1: secret)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    upto = lambda a, b: int(rng.integers(a, b))
    hexa, low = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    digit, up = "0123456789", low.upper()
    every = low + up + digit
    filler = lambda: " ".join(some(low, upto(2, 9)) for _ in range(upto(1, 6)))
    leet = lambda w: "".join({"a": "@", "o": "0", "e": "3", "i": "1", "s": "$"}.get(c, c) if rng.random() < 0.6 else c for c in w)

    def human() -> str:
        """A password that a person would choose: words, changed letters, digits and signs."""
        word = lambda: pick([pick(COMMON), some(low, upto(4, 9)), leet(pick(COMMON))])
        w = pick([word(), word().capitalize(), word() + word().capitalize()])
        tail = pick([some(digit, upto(2, 5)), some(digit, upto(1, 4)) + pick("!@#$%&*?"), pick("!@#$_-") + some(digit, upto(2, 5)), some(digit, 2) + some(low, upto(2, 4))])
        return w + tail if rng.random() < 0.8 else tail + w

    out = []
    for i in range(n):
        quote = pick(['"', "'", ""])
        sign = pick([" = ", "=", ": ", '": "' if quote == '"' else ":", " => " if quote else "="])
        given = pick(NAMES) + sign + ("" if sign.endswith('"') else quote)
        if i % 2:
            value, lead = pick([
                lambda: (pick(["AKIA", "ASIA"]) + some(up + "234567", 16), pick(["", "key ", "id = "])),
                lambda: (some(hexa, pick([16, 18, 20, 24, 32, 40, 64])), given),
                lambda: (some(every, upto(10, 48)), given),
                lambda: (some(every + "+/_-", upto(20, 64)), given),
                lambda: ("ghp_" + some(every, 36), pick(["", "token "])),
                lambda: (some(every + "+/", 40), pick(["aws_secret ", "secret_access_key = ", "export SECRET="])),
                lambda: (human(), pick(["password", "passwd", "pwd", "secret"]) + given[given.index(sign[0]) :] if sign[0] in given else given),
                lambda: (human(), given),
            ])()
            if rng.random() < 0.06:
                value, lead = (value, lead) if value.startswith("gh") else (value.upper(), lead.upper())
        else:
            cased = lambda w: w.upper() if rng.random() < 0.4 else w
            joined = lambda: cased(pick(["_", "_", ".", "-"]).join(pick(COMMON + DUMMY + NAMES[:6]) for _ in range(upto(1, 4))))
            value, lead = pick([
                lambda: (pick(["your_", "my_", "example_", "test-"]) + pick(DUMMY) + pick(["_here", "", "123", "_" + pick(COMMON)]), given),
                lambda: (pick("xX0*") * upto(8, 40), given),
                lambda: (some(hexa, pick([32, 40, 64])), pick(["commit ", "sha256 ", "md5 checksum ", "revision ", "digest ", "sha1: ", "checksum = "])),
                lambda: ("-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), pick(["uuid ", "id ", "order ", "guid="])),
                lambda: (pick(COMMON) + "/" + pick(COMMON) + "/" + pick(COMMON) + "-" + some(digit, 4), pick(["path ", "file /", "see "])),
                lambda: (pick(COMMON) + pick(COMMON) + pick(COMMON) + pick(COMMON) + some(digit, 2), filler() + " "),
                lambda: (joined(), given),
                lambda: (some(low, upto(6, 10)), given),
                lambda: (pick(["${", "{{", "<", "$(", "%("]) + joined() + pick(["}", "}}", ">", ")", ")s"]), given),
                lambda: (joined() + pick(["()", "(request)", "[0]", "['" + joined() + "']", "[\"" + joined() + "\"]", "(\"" + joined() + "\")"]), pick(NAMES) + pick([" = ", "="])),
                lambda: ("/" + pick(COMMON) + "/" + pick(COMMON) + "/" + pick(COMMON), given),
                lambda: ("AKIA" + some(up, 6) + "EXAMPLE" + some(up, 3), "key "),
            ])()
        value += "x" * max(0, 6 - len(value))
        out.append((filler() + pick([" ", "\n", ". "]) + lead + "\x02" + value + "\x03" + quote + " " + filler(), i % 2))
    return out


def train(findings: list[tuple[str, int]]) -> Forest:
    rows = []
    for marked, _ in findings:
        a, b = marked.index("\x02"), marked.index("\x03") - 1
        text = marked.replace("\x02", "").replace("\x03", "")
        a, b, kind = next(((s, e, k) for s, e, k in candidates(text) if s < b and a < e), (a, b, "run"))  # as it will be cut
        rows.append(features(text, a, b, kind))
    return Forest(np.array(rows), np.array([f[1] for f in findings]))


@lru_cache(1)
def default_forest() -> Forest:
    return train(labelled_findings())


def judged(texts: list[str], forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of each text's candidates; a value scores no less than what lies inside it."""
    found = [nested(t) for t in texts]
    rows = [features(t, *c) for t, cs in zip(texts, found, strict=True) for *own, inner in cs for c in (own, *inner)]
    score = iter(forest.predict(np.array(rows)).tolist() if rows else [])
    return [[(a, b, kind, max(next(score) for _ in range(1 + len(inner)))) for a, b, kind, inner in cs] for cs in found]


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each candidate of every document: id, start, end, kind, score, secret (whether it is one)."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            got = judged(b.column(1).to_pylist(), shared.value)
            rows = [(i, *f, f[3] >= threshold) for i, fs in zip(b.column(0).to_pylist(), got, strict=True) for f in fs]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "start", "end", "kind", "score", "secret"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")).where(F.regexp_like("_text", F.lit(MARK)))
    return own.mapInArrow(run, plain_schema("id long, start long, end long, kind string, score double, secret boolean")).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns; secrets in the text are replaced. Texts without a mark pass by Python unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        out = []
        for t, found in zip(texts, judged([t or "" for t in texts], shared.value), strict=True):
            at, parts = 0, []
            for a, b, _, score in found:
                if score >= threshold:
                    parts += [t[at:a], mark]
                    at = b
            out.append(t if not parts else "".join([*parts, t[at:]]))
        return texts.__class__(out)

    hit = F.coalesce(F.regexp_like(text_col, F.lit(MARK)), F.lit(False))
    name = clear_name(docs, "_hit")
    marked = docs.withColumn(name, hit)
    kept = marked.where(~F.col(name)).drop(name)
    return kept.unionByName(marked.where(F.col(name)).drop(name).withColumn(text_col, clean(F.col(text_col))))
