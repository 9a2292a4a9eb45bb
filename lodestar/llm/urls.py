"""URL filter: longest-match rules, then gradient-boosted trees on lexical features.

Features: lengths of host, path and query, depth of host and path, digit ratio of the url and of the host, entropy of both,
parameter count, hyphens in the host, and suffix statistics (share of blocked labelled
URLs under the host's last label and under its last two, smoothed). No feature knows words. The trees are trained on labelled
URLs, which are a parameter: labelled_urls() makes a bounded, seeded set of made-up names. Those to block are shaped as in
public feeds of spam and phishing URLs: names strung together by hyphens, generated hosts, digits in the host, many
subdomains, tracking links of many parameters, suffixes that are given away; some plain ones share each of these traits. Those
to allow have the shapes of ordinary sites under many suffixes: spoken or short names, titles, dates, ids, articles.

Cases: a null url or one without :// has an empty host and path, fits no rule and is allowed; very long urls are judged
whole; repeated rows get equal verdicts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import wider
from .trees import Boosted

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

HOST = r"^(?s).*?://([^/?#]*)"


def host_of(url: Column) -> Column:
    """A-Z to lower case; other letters stay."""
    found = F.regexp_extract(url, HOST, 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that begins with its path."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, text).otherwise(out)
    return out


def labelled_urls(n: int = 9000, seed: int = 5) -> tuple[list[str], np.ndarray]:
    """URLs and labels (1: block), the same at every call."""
    rng = np.random.default_rng(seed)
    pick = lambda words: words[int(rng.integers(len(words)))]
    some = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    upto = lambda a, b: int(rng.integers(a, b))
    syllables = [c + v for c in "bcdfghklmnprstvw" for v in "aeiou"] + "th er in on an sh tion ing ly st nt re es ed ou le ble and the wh ch en".split()
    name = lambda a=2, b=5: "".join(pick(syllables) for _ in range(upto(a, b)))
    small = "abcdefghijklmnopqrstuvwxyz0123456789"
    hosts = {
        "plain": lambda: name(),
        "hyphen": lambda: "-".join(name(1, 4) for _ in range(upto(2, 5))),
        "made": lambda: some(small[:26] if rng.random() < 0.5 else small, upto(9, 24)),
        "digits": lambda: name(1, 3) + some("0123456789", upto(2, 7)) + pick(["", name(1, 2)]),
        "deep": lambda: ".".join(name(1, 4) for _ in range(upto(3, 6))),
    }
    out, labels = [], (np.arange(n) % 3 == 0).astype(int)
    for label in labels.tolist():
        if not label and rng.random() < 0.6:
            out.append(_ordinary(rng, pick, upto, some, name))
            continue
        kind = pick(["hyphen", "hyphen", "hyphen", "made", "digits", "deep", "links"] if label else ["plain"] * 17 + ["hyphen", "digits", "deep"])
        host = hosts.get(kind, hosts["plain"])()
        end = pick([".example.com", ".example.net", ".example.org"]) if rng.random() < 0.5 else "." + (pick(CHEAP) if label and rng.random() < 0.6 else pick(ENDS))
        lead = pick(["", "", "", "www.", "blog.", "m.", "shop."])
        depth = upto(2, 7) if kind == "links" else upto(0, 4)
        path = "".join("/" + pick([name(1, 3), str(upto(1, 9999)), pick(["en", "de", "fr", "es"])]) for _ in range(depth)) + pick(["", "/", ".html"])
        params = upto(3, 12) if kind == "links" else pick([0, 0, 0, 1, 2])
        query = "&".join(f"{name(1, 2)}={some(small, upto(8, 40)) if kind == 'links' else pick([name(1, 3), str(upto(1, 50))])}" for _ in range(params))
        out.append(pick(["http://", "https://"]) + lead + host + end + (path if path.startswith("/") else "/") + ("?" + query if query else "") + pick(["", "", "", "#top"]))
    return out, labels


# fixed values: suffixes of ordinary sites, and those that are given away
ENDS = "com com com com com com com com com com org org org org net net info edu edu gov gov io io ai dev app tv me de de fr fr it es nl be ch at se no dk fi pl cz ru ua jp jp cn in br au ca ca eu us uk co.uk co.uk co.uk org.uk gov.uk gov.uk ac.uk ac.uk nhs.uk co.jp ac.jp com.au gov.au edu.au com.br co.in gov.in co.nz co.za com.cn com.tr co.kr or.jp int mil museum google blog".split()
CHEAP = "top xyz win click loan icu buzz cyou rest gq tk ml cf ga".split()


def _ordinary(rng, pick, upto, some, name) -> str:  # noqa: ANN001
    """A URL as sites of news, science, code, shops and offices have them: short or spoken names, few labels, titles, dates, ids."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    brand = pick([lambda: name(), lambda: some(letters, upto(2, 6)), lambda: name(1, 3) + name(1, 2), lambda: name(1, 3) + "-" + name(1, 4)])()
    lead = pick(["", "", "www.", "www.", "www.", "en.", "docs.", "news.", "www2.", name(1, 2) + ".", name(1, 2) + "." + some(letters, upto(2, 5)) + "."])
    title = lambda sign: sign.join(name(1, 4) for _ in range(upto(2, 10)))
    step = [
        lambda: name(1, 4), lambda: title("-"), lambda: title("_").title(), lambda: str(upto(1990, 2026)), lambda: f"{upto(1, 13):02d}",
        lambda: str(upto(1, 10**8)), lambda: some(letters, 3).upper() + str(upto(1, 10**7)), lambda: name(1, 2) + "-" + str(upto(1, 10**8)),
        lambda: "v" + str(upto(1, 20)) + "." + str(upto(0, 20)), lambda: f"{upto(1000, 2600)}.{upto(10000, 99999)}", lambda: some("0123456789abcdef", pick([7, 12, 40])),
        lambda: name(1, 3).upper(), lambda: "@" + name(1, 3),
    ]
    path = "".join("/" + pick(step)() for _ in range(upto(0, 6)))
    tail = pick(["", "", "", "/", ".html", ".htm", ".php", ".pdf", ".txt"]) if path else pick(["", "/"])
    query = "&".join(f"{pick(['id', 'q', 'page', 'lang', 'v', name(1, 2)])}={pick([name(1, 4), str(upto(1, 10**6)), some(letters + '0123456789', 11)])}" for _ in range(pick([0, 0, 0, 0, 1, 1, 2, 3])))
    return pick(["https://", "https://", "http://"]) + lead + brand + "." + pick(ENDS) + path + tail + ("?" + query if query else "") + pick(["", "", "", "", "#" + name(1, 4)])


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * np.log2(c / n) for c in Counter(text).values()) if n else 0.0


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, what follows)."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(.*)", url or "")
    return (m[1].lower(), m[2], m[3]) if m else ("", "", "")


#: The features, in the order of their columns.
FEATURES = ("host length", "path length", "query length", "host depth", "path depth", "digit ratio", "host digit ratio", "entropy", "host entropy", "parameters", "hyphens", "suffix", "long suffix")


class Model:
    """The trees and the suffix statistics of labelled URLs."""

    def __init__(self, urls: list[str], labels: np.ndarray) -> None:
        suffix: dict[str, list[float]] = defaultdict(lambda: [1.0, 2.0])
        for url, label in zip(urls, labels.tolist(), strict=True):
            for k in self.suffixes(split_url(url)[0]):
                suffix[k][0] += label
                suffix[k][1] += 1
        # a suffix of few urls would only repeat their labels; one that is not known is taken for one of an allowed url
        self.suffix = {k: a / b for k, (a, b) in suffix.items() if b >= 22}
        good = [self.suffix[k] for url, label in zip(urls, labels.tolist(), strict=True) if not label for k in self.suffixes(split_url(url)[0])[:1] if k in self.suffix]
        self.unknown = float(np.mean(good)) if good else 0.5
        self.trees = Boosted(self.features(urls), labels, trees=80, depth=3)

    @staticmethod
    def suffixes(host: str) -> list[str]:
        return [".".join(host.split(".")[-k:]) for k in (1, 2)]

    def features(self, urls: list[str | None]) -> np.ndarray:
        rows = []
        digits = lambda t: sum(c.isdigit() for c in t) / max(1, len(t))
        for url in urls:
            host, path, rest = split_url(url)
            short, long = (self.suffix.get(s, self.unknown) for s in self.suffixes(host))
            rows.append([len(host), len(path), len(rest), host.count("."), path.count("/"), digits(url or ""), digits(host), entropy(url or ""), entropy(host), rest.count("="), host.count("-"), short, long])
        return np.array(rows, float).reshape(len(urls), len(FEATURES))

    def splits(self) -> dict[str, int]:
        """How often the trees split on each feature."""
        at = np.concatenate([t.feature for t in self.trees.trees])
        return {f: int((at == i).sum()) for i, f in enumerate(FEATURES)}

    def predict(self, urls: list[str | None]) -> np.ndarray:
        """Likelihood that a URL is to be blocked."""
        return self.trees.predict(self.features(urls))


@lru_cache(1)
def default_model() -> Model:
    return Model(*labelled_urls())


def judge(pages: DataFrame, model: Model | None = None, rules: tuple = RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score of each url. No shuffle; the trees are broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("_url"))
    own = own.select(F.col("id"), "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), "_url")
    schema = wider(own.drop("_url").schema, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.predict(b.column(4).to_pylist())
            none = np.array([not h for h in b.column(1).to_pylist()], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(np.where(none, 0.0, got))], names=schema.names)

    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for text, what in rules:
        verdict = F.when(F.col("rule") == text, what).otherwise(verdict)
    return own.mapInArrow(run, schema).withColumn("verdict", verdict).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score")
