"""Secret scans: a wide net of regular expressions, then a random forest that removes false positives.

Candidates are private key blocks, values assigned to names such as password, and runs of at least 16
token characters that hold a digit. The forest judges each by length, character transitions and classes,
dictionary coverage, path-like parts and neighbouring words. It is trained on labelled findings
(default: findings made by rule, see labelled_findings) in numpy on the driver, over a bounded table, and
becomes one SQL expression, so scanning runs in Spark's own functions only.

Null and empty texts have no findings. Rows that repeat are scanned each. Extra columns are ignored by
findings() and kept by redact(). Places count code points from 0.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh
from .fingerprints import let

# How secrets are named and how they begin.
NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xox[abprs]-|AIza|ya29|eyJ|npm_|hf_|-----BEGIN"
BENIGN = "example|sample|dummy|placeholder|uuid|guid|sha1|sha256|md5|commit|checksum|digest|revision|version|phone|tel|fax|order|invoice|isbn|card|serial|http|www|url|mail|path|file|image"
DICTIONARY = "example|sample|dummy|placeholder|test|your|here|change|secret|password|token|user|name|mail|file|path|http|https|www|com|org|net|html|json|index|image|images|static|assets|version|release|build|src|lib|node|module|package|the|and|for|with|this|that|key|api|value|string|null|true|false|data|page|article|news|docs|home|about|server|client|localhost|admin|default|config|settings"

TOKEN = "A-Za-z0-9_+/~."
BLOCK = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\\s:,-]*?-----END [A-Z ]{0,30}PRIVATE KEY-----"
ASSIGNED = f"(?<=(?i:{NAMES})[\"']?[ ]{{0,2}}[:=][ ]{{0,2}}[\"']?)[^\\s\"'\\[\\],;:=]{{8,}}"
RUN = f"(?<![{TOKEN}-])(?=[A-Za-z_+/.~-]*[0-9])[A-Za-z0-9_+/.~-]{{16,}}={{0,2}}"
CANDIDATE = f"{BLOCK}|{ASSIGNED}|{RUN}"
#: A text without any of these has no candidate.
POSSIBLE = f"[0-9]|(?i:{NAMES})[\"']?[ ]{{0,2}}[:=]|PRIVATE KEY"
NEAR = 40
MASK = "[SECRET]"
TREES, DEPTH, LEAST_LEAF, THRESHOLD = 15, 6, 4, 0.5
MOST_LABELLED = 20_000

FEATURES = ("length", "transitions", "digits", "upper", "lower", "distinct", "hex", "dictionary", "path", "named", "benign", "assigned", "prefixed", "repeated", "quoted", "mail")


def features(before: Column, found: Column, after: Column) -> list[Column]:
    n = F.length(found).cast("double")
    share = lambda pattern: F.regexp_count(found, F.lit(pattern)) / n
    has = lambda text, pattern: F.when(text.rlike(pattern), 1.0).otherwise(0.0)
    return [
        n,
        share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        F.size(F.array_distinct(F.split(found, ""))) / n,
        has(found, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        1 - F.length(F.regexp_replace(F.lower(found), F.lit(DICTIONARY), F.lit(""))) / n,
        share("[/.]"),
        has(before, f"(?i)(?:{NAMES}|bearer|private)[^\\s]{{0,12}}\\s*[:=]?\\s*[\"']?$"),
        has(before, f"(?i)(?:{BENIGN})[^\\s]{{0,6}}\\s*[:=#/]?\\s*[\"']?$"),
        has(before, "[:=]\\s*[\"']?$"),
        has(found, f"^(?:{PREFIXES})"),
        has(found, "(.)\\1\\1\\1|[xX*#]{4,}|0123|1234|abcd"),
        F.when(before.rlike("[\"']$") & after.rlike("^[\"']"), 1.0).otherwise(0.0),
        F.when(before.rlike("@$|://[^\\s]*$") | after.rlike("^@"), 1.0).otherwise(0.0),
    ]


@lru_cache(maxsize=1)
def labelled_findings(n: int = 2400) -> list[tuple[str, str, str, int]]:
    """(before, found, after, is_secret), made by rule with a fixed seed: keys, tokens and passwords as they
    are written down, against hashes, ids, addresses, paths, numbers, placeholders and long names."""
    rng = np.random.default_rng(11)
    pick = lambda chars, k: "".join(rng.choice(list(chars), int(k)))
    one = lambda text: str(rng.choice(text.split()))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick("aeioutnrslhd", rng.integers(2, 9))
    prose = lambda: " ".join(word() for _ in range(rng.integers(1, 5)))
    named = lambda: f"{one('password token secret api_key access_key passwd pwd auth_token client_secret')}{one('= : =_ :_').replace('_', ' ')}"
    uuid = lambda: "-".join(pick(dig + "abcdef", k) for k in (8, 4, 4, 4, 12))
    def name(k):
        return "".join(one("user name file path image index version release build module data page config default server client value string example").capitalize() for _ in range(k))

    secret = [
        lambda: ("", f"AKIA{pick(up + dig, 16)}", ""),
        lambda: (named(), pick(dig + "abcdef", rng.choice([16, 18, 20, 24, 32, 40, 64])), ""),
        lambda: (named().rstrip() + ' "', pick(dig + "abcdef", rng.choice([18, 32, 40, 64])), '"'),
        lambda: ("token = \"", pick(low + up + dig, rng.integers(20, 60)), '"'),
        lambda: (named(), pick(low + up + dig + "_-+/", rng.integers(16, 64)), ""),
        lambda: ("", one("ghp_ gho_ glpat- sk_live_ sk- xoxb- hf_ npm_") + pick(low + up + dig, rng.integers(20, 44)), ""),
        lambda: ("", "AIza" + pick(low + up + dig + "_-", 35), ""),
        lambda: ("Bearer ", "eyJ" + pick(low + up + dig, 40) + "." + pick(low + up + dig, 60) + "." + pick(low + up + dig + "_-", 43), ""),
        lambda: ("", f"-----BEGIN RSA PRIVATE KEY-----\n{pick(low + up + dig + '+/', 300)}\n-----END RSA PRIVATE KEY-----", ""),
        lambda: (f"{one('password passwd pwd')}{one('= :')}", pick(low + up + dig + "!$%", rng.integers(9, 20)), ""),
        lambda: ("", pick(low + up + dig + "+/", 43) + "=", ""),
    ]
    plain = [
        lambda: ("@", f"mail{rng.integers(0, 99)}.example.com", ""),
        lambda: ("", f"{word()}.{word()}{rng.integers(0, 99)}{word()}{word()}", "@mail.example.com"),
        lambda: (one("commit sha1 md5 checksum: sha256= digest revision") + " ", pick(dig + "abcdef", rng.choice([32, 40, 64])), ""),
        lambda: (one("id uuid guid= order request_id:") + " ", uuid(), ""),
        lambda: ("", uuid(), ""),
        lambda: ("https://", f"{word()}.example.com/{word()}/{word()}-{rng.integers(1, 9999)}/{word()}.html", ""),
        lambda: ("", f"/usr/{word()}/{word()}{rng.integers(1, 9)}/{word()}/{word()}.txt", ""),
        lambda: ("", pick(dig, rng.integers(16, 24)), ""),
        lambda: (one("card phone tel serial isbn") + " ", pick(dig, rng.integers(16, 20)), ""),
        lambda: (one("call tel phone:") + " ", f"{pick(dig, 3)}-{pick(dig, 3)}-{pick(dig, 4)}-{pick(dig, 6)}", ""),
        lambda: ("", f"{pick(dig, 4)}-{pick(dig, 2)}-{pick(dig, 2)}T{pick(dig, 2)}.{pick(dig, 2)}.{pick(dig, 6)}", ""),
        lambda: (named(), one("your_api_key_here_123 changeme12345678 example_password_1 xxxxxxxxxxxx1234 test_token_0123456789 <password> ${PASSWORD_1} placeholder_secret1"), ""),
        lambda: (one("token: secret: auth: password:") + " ", one("required optional disabled undefined settings.auth configuration authentication verification"), ""),
        lambda: ("", name(rng.integers(3, 6)) + str(rng.integers(1, 99)), ""),
        lambda: ("", "_".join(word() for _ in range(5)) + f"_v{rng.integers(1, 99)}", ""),
        lambda: ("", "-".join(word() + word() for _ in range(3)) + f"-{rng.integers(1, 2030)}", ""),
        lambda: ("version ", f"{rng.integers(1, 20)}.{rng.integers(0, 99)}.{rng.integers(0, 99)}-{one('alpha beta rc release')}.{rng.integers(1, 9)}+build{rng.integers(1, 999)}", ""),
        lambda: ("", word() + pick("0123456789", 1) * 16, ""),
        lambda: ("", "." * 12 + pick(dig, 4), ""),
    ]
    out = []
    for i in range(n):
        kinds, label = (secret, 1) if i % 2 else (plain, 0)
        before, found, after = kinds[(i // 2) % len(kinds)]()
        out.append(((f"{prose()} {before}")[-NEAR:], found, f"{after} {prose()}"[:NEAR], label))
    return out


class Forest:
    """Classification trees on bootstrap samples, a random subset of features tried at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.tries = max(2, round(x.shape[1] ** 0.5) + 1)
        self.trees = []
        for _ in range(trees):
            rows = self.rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows].astype(float), depth))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if not depth or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
            return float((y.sum() + 0.5) / (len(y) + 1))
        best = None
        for f in self.rng.choice(x.shape[1], self.tries, replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= LEAST_LEAF) & (cut <= len(y) - LEAST_LEAF)]
            if len(cut):
                left, right = t[cut - 1], t[-1] - t[cut - 1]
                gini = left * (1 - left / cut) + right * (1 - right / (len(y) - cut))
                k = int(np.argmin(gini))
                if best is None or gini[k] < best[0]:
                    best = (gini[k], f, (v[cut[k] - 1] + v[cut[k]]) / 2)
        if best is None:
            return float((y.sum() + 0.5) / (len(y) + 1))
        _, f, at = best
        side = x[:, f] <= at
        return int(f), float(at), self._grow(x[side], y[side], depth - 1), self._grow(x[~side], y[~side], depth - 1)

    def expression(self, x: list[Column]) -> Column:
        def tree(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            f, at, left, right = node
            return F.when(x[f] <= at, tree(left)).otherwise(tree(right))

        total = tree(self.trees[0])
        for t in self.trees[1:]:
            total = total + tree(t)
        return total / len(self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def value(node, row):
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([sum(value(t, row) for t in self.trees) / len(self.trees) for row in x])


def train(spark: SparkSession, labelled: DataFrame | None = None) -> Forest:
    """Fit on labelled findings (before, found, after, is_secret), at most MOST_LABELLED of them."""
    if labelled is None:
        labelled = spark.createDataFrame(labelled_findings(), "before string, found string, after string, is_secret int")
    rows = labelled.select(*features(F.col("before"), F.col("found"), F.col("after")), "is_secret").limit(MOST_LABELLED).collect()
    table = np.array([[float(v) for v in r] for r in rows])
    return Forest(table[:, :-1], table[:, -1])


def _score(forest: Forest, before: Column, found: Column, after: Column) -> Column:
    named = F.struct(*[c.alias(n) for c, n in zip(features(before, found, after), FEATURES, strict=True)])
    return let(named, lambda f: forest.expression([f.getField(n) for n in FEATURES]))


def _cut(text: Column) -> tuple[Column, Column]:
    """The stretches between candidates (one more than those), and the candidates."""
    return F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def _tail(text: Column) -> Column:
    return F.right(text, F.lit(NEAR))


def findings(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """(doc_id, start, length, found, score) of the candidates that the forest takes for secrets."""
    forest = forest or train(docs.sparkSession)
    texts = docs.select("doc_id", "text").where(F.col("text").rlike(POSSIBLE))
    between, found = _cut(F.col("text"))
    cut = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), between.alias("between"), found.alias("found")).where("size(found) > 0")
    each = cut.select("doc_id", "row", F.posexplode(F.transform("found", lambda x, i: F.struct(x.alias("found"), F.length(F.get("between", i)).alias("gap"), _tail(F.get("between", i)).alias("before"), F.left(F.get("between", i + 1), F.lit(NEAR)).alias("after")))).alias("i", "c"))
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.select("doc_id", "c.*", (F.coalesce(F.sum(F.col("c.gap") + F.length("c.found")).over(so_far), F.lit(0)) + F.col("c.gap")).alias("start"))
    scored = placed.withColumn("score", _score(forest, F.col("before"), F.col("found"), F.col("after"))).where(F.col("score") >= THRESHOLD)
    return scored.select("doc_id", F.col("start").cast("bigint"), F.length("found").cast("bigint").alias("length"), "found", F.round("score", 6).alias("score"))


def redact(docs: DataFrame, forest: Forest | None = None, text: str = "text") -> DataFrame:
    """docs with each secret in the text replaced by MASK; n_chars, where there, follows, every other column
    and all rows are kept."""
    forest = forest or train(docs.sparkSession)
    between, found = _cut(F.col(text))

    def masked(parts: Column) -> Column:
        gaps, hits = parts.getField("gaps"), parts.getField("hits")

        def one(x: Column, i: Column) -> Column:
            score = _score(forest, _tail(F.get(gaps, i)), x, F.left(F.get(gaps, i + 1), F.lit(NEAR)))
            return F.concat(F.get(gaps, i), F.when(score >= THRESHOLD, F.lit(MASK)).otherwise(x))

        return F.concat(F.array_join(F.transform(hits, one), ""), F.element_at(gaps, -1))

    changed = let(F.struct(between.alias("gaps"), found.alias("hits")), lambda p: F.when(F.size(p.getField("hits")) > 0, masked(p)).otherwise(F.array_join(p.getField("gaps"), "")))
    (after,) = fresh(docs, "after")
    out = docs.withColumn(after, F.when(F.col(text).rlike(POSSIBLE), changed).otherwise(F.col(text)))
    size = {"n_chars": F.when(F.col(after) == F.col(text), F.col("n_chars")).otherwise(F.char_length(after)).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {}
    return out.select(*[F.col(after).alias(c) if c == text else size[c].alias(c) if c in size else F.col(f"`{c}`") for c in docs.columns])
