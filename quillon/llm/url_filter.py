"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, mix, table, utf8_bytes

BUCKETS = 1 << 14
WIDTHS = (3, 4, 5)
#: Least probability of a URL that is blocked.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))

# The labelled URLs: names of unwanted and of wanted sites as a reviewer would list them, each in a few forms (see labelled_urls).
UNWANTED = """online-casino casino-royal vegas-slots poker-bonus betting-tips best-bets bet-now live-bet pills-shop pill-store cheapmeds viagra-deal
    xxx-adult adult-cams porn-tube sex-chat hot-singles click-track trackers ad-server ads-network popads banner-ads spam-links bulk-spam
    spammer link-farm content-farms win-money lottery-win win-prize free-spins freebies-now free-cash payday-loan fast-cash crypto-double""".split()
WANTED = """news daily-post city-library university health-info museum weather open-data science-blog recipes gardening history music-notes
    school travel-guide sports-results thinker brother northern winter birdwatching freedom pillar addition farmhouse window adulthood
    archive journal gazette observatory orchestra theatre cinema kitchen bakery carpenter physics chemistry biology geology astronomy
    mathematics algebra geometry poetry novel grammar dictionary encyclopedia atlas river mountain valley harbour island forest meadow
    railway station airport bicycle engine bridge castle cathedral village parliament council ministry senate court justice statistics
    census budget treasury hospital clinic pharmacy dentist nursing research institute academy college kindergarten students teachers
    photography painting sculpture design architecture software hardware compiler database network protocol forum wiki manual handbook""".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """Host, path and label (1: block) of the training table. A URL without a host speaks for nothing unwanted."""
    names = [(x, 1) for x in UNWANTED] + [(x, 0) for x in WANTED]
    forms = [("", "com", "/en/12"), ("www.", "net", "/fr/345/"), ("blog.", "org", "/de/6789.html"), ("m.", "info", "/es/42"), ("", "co.uk", "/"), ("www.", "edu", "")]
    return [(f"{sub}{x}.{top}", path, y) for x, y in names for sub, top, path in forms] + [("", "", 0)] * len(forms)


def grams(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every character n-gram of host and of path, each closed by marks."""
    rows, buckets = [], []
    for seed, (column, left, right) in enumerate(((hosts, b"^", b"$"), (paths, b"<", b">"))):
        data, offsets = utf8_bytes(column)
        n = len(offsets) - 1
        size = np.diff(offsets)
        at = offsets[:-1] + 2 * np.arange(n)
        closed = np.empty(len(data) + 2 * n, np.uint8)
        closed[at], closed[at + size + 1] = left[0], right[0]
        closed[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, size)] = data
        row = np.repeat(np.arange(n), size + 2)
        for width in WIDTHS:
            m = len(closed) - width + 1
            if m <= 0:
                continue
            h = np.full(m, seed * 16 + width, U64)
            for k in range(width):
                h = h * U64(257) + closed[k : k + m]
            inside = row[:m] == row[width - 1 :]
            rows.append(row[:m][inside])
            buckets.append((mix(h[inside]) & U64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(buckets or [np.empty(0, np.int64)])


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, bucket = grams(hosts, paths)
        count = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
        z = self.bias + np.bincount(row, self.weights[bucket], minlength=len(hosts)) / np.sqrt(count)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[str, str, int]], epochs: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Adagrad on the log loss of the whole table, both labels with the same weight."""
    row, bucket = grams(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]))
    y = np.array([r[2] for r in rows], float)
    x = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b, g, g_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs):
        z = b + np.bincount(row, w[bucket], minlength=len(y)) * x
        error = (1 / (1 + np.exp(-z)) - y) * each
        grad = np.bincount(bucket, (error * x)[row], minlength=BUCKETS) + decay * w
        g, g_b = g + grad**2, g_b + error.sum() ** 2
        w -= rate * grad / np.sqrt(g)
        b -= rate * error.sum() / np.sqrt(g_b)
    return Model(b, w)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    host = F.when(has, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_of(rules: tuple[Rule, ...], answer) -> Column:
    """The answer of the longest rule that fits, of equally long ones the first; null without any."""
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    return reduce(lambda rest, r: F.when(fits(r), F.lit(answer(r))).otherwise(rest), reversed(sorted(rules, key=lambda r: -len(r.text))), F.lit(None).cast("string"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, table_rows: list[tuple[str, str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, score.

    A null url, and one without ``://``, has an empty host and path: no rule fits, and the model judges the empty strings. Repeated ids and urls get a row each. Other columns, as html, are not read.
    """
    fitted = fit(labelled_urls() if table_rows is None else table_rows)
    sent = pages.sparkSession.sparkContext.broadcast((fitted.bias, fitted.weights))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = Model(*sent.value)
        for batch in batches:
            yield table({"page_id": batch.column("page_id"), "host": batch.column("host"), "path": batch.column("path"), "score": model.score(batch.column("host"), batch.column("path"))}, schema)

    host, path = parts(F.col("url"))
    scored = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, score double")
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule_of(rules, lambda r: r.text).alias("rule"), F.coalesce(rule_of(rules, lambda r: r.verdict), by_model).alias("verdict"), "score")
