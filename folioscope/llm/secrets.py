"""Secret scan: candidates by pattern, false positives removed by a random forest.

Main path in DataFrame functions only. Candidates are marked in the text, cut out with
their surroundings as an array, described by numbers, and judged by trees that are held
as literal arrays and walked with higher-order functions. The forest is fitted on labelled
findings on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

RUN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9])[A-Za-z0-9_+/\-]{12,}+"
NAME = r"[A-Za-z0-9_.\-]"
#: What a value can't hold unless it is quoted, and what it doesn't end with.
STOP, LAST = r"\s\"'`,;<>\\\x01\x02", r".:!?)}\]"
#: A key file, or its first line where the last is missing.
KEY_BLOCK = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^\-]*+(?:-{1,4}+[^\-]++){0,64}+-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
)
#: (before)(value) of "name = value", the name holding a secret word; quoted ones may hold
#: blanks, but then no run that is a candidate by itself.
ASSIGNED = (
    rf"(?<!{NAME})((?={NAME}{{2,80}}+[\"']?[ \t]{{0,3}}[:=])"
    rf"(?={NAME}*?(?i:token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)){NAME}++"
    r"[\"']?[ \t]{0,3}(?::=|=>|==|[:=])[ \t]{0,3}(?:(?i:bearer|basic) )?[\"'`]?)"
    rf"((?<=\")(?![^\"\n]*?{RUN})[^\"\n\x01\x02]{{1,200}}(?=\")|(?<=')(?![^'\n]*?{RUN})[^'\n\x01\x02]{{1,200}}(?=')"
    rf"|[^{STOP}]*[^{STOP}{LAST}])"
)
#: (before)(value) of "user:value@host".
IN_ADDRESS = (
    rf"(?<!{NAME})((?:[A-Za-z][A-Za-z0-9+.\-]{{0,15}}+://)?(?!(?i:mailto):)(?={NAME}{{0,64}}+:[^\s/@\"'<>]{{1,128}}+@[A-Za-z0-9]){NAME}*+:)"
    r"([^\s/@\"'<>\x01\x02]++)(?=@)"
)
#: A run of 12 or more characters of keys with a digit among them, such runs joined by dots,
#: and the other forms above.
CANDIDATE = (
    rf"{ASSIGNED}|{IN_ADDRESS}|("
    r"(?<![A-Za-z0-9_+/\-])(?:eyJ[A-Za-z0-9_\-]{5,}+(?:\.[A-Za-z0-9_\-]{2,}+){1,4}+|SG\.[A-Za-z0-9_\-]{16,}+\.[A-Za-z0-9_\-]{16,}+)"
    rf"|{RUN}(?:\.[A-Za-z0-9_\-]{{12,}}+){{0,4}}+={{0,2}}"
    rf"|{KEY_BLOCK})"
)
MARKED = "$1$3\u0001$2$4$5\u0002"
OPEN, CLOSE = "\u0001", "\u0002"
BEFORE, AFTER = 40, 20
TREES, DEPTH = 25, 6
#: Pieces of a text whose lengths are added up together.
RUNS = 64
#: Largest number of labelled findings that the forest is fitted on.
FIT_FINDINGS = 6000
# Words and letter pairs that describe a candidate and its surroundings.
DICTIONARY = (
    "account action address after agent array before build button cache class client code column common config"
    " content context control count create data date default delete detail device document domain download edit"
    " element email enable entry error event example feature field file filter folder format function group handle"
    " header helper history image index info input item json label layer layout line link list load local lock"
    " manager master message method mode model module month name node number object option order output package"
    " page param path policy price process product profile project query read record release report request result"
    " return route sample save script search second section select server service session setting sort source start"
    " state static status store string style system table target task template test text time title total type"
    " update upload user util value version video view widget window write year the and ing ion ent her tha for"
).split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
SECRET_WORDS = r"(?i)token|secret|passw|pwd|api.?key|access.?key|credential|bearer|auth|private"
DIGEST_WORDS = r"(?i)sha|commit|checksum|digest|md5|uuid|guid|etag|hash|revision|build|integrity|version|card|phone|order|isbn"
PLACEHOLDER = r"(?i)example|dummy|placeholder|sample|changeme|change_me|your[_-]|xxxx|0000000|123456789|redacted|fake|mock|test"
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live|sk-|rk_live|xox[abp]-|AIza|eyJ|SG\.|npm_|-----BEGIN)"
SHY_PATH = r"(?i)test|example|fixture|mock|spec|sample|docs|readme|lock|\.sum"
FEATURES = (
    "length digits upper symbols transitions hex pairs dictionary distinct secret_word digest_word placeholder prefix"
    " assigned numeric shy_path slashes quoted in_address letters expression"
).split()


def features(candidate: Column, before: Column, after: Column, path: Column) -> Column:
    """The numbers that the forest sees, in the order of FEATURES."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    low = F.lower(candidate)
    flag = lambda c: c.cast("double")
    share = lambda pattern: F.regexp_count(candidate, F.lit(pattern)) / n
    near = F.concat_ws(" ", before, after)
    turns = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[_+/=-])(?=[^_+/=-])"
    return F.array(
        n, share("[0-9]"), share("[A-Z]"), share("[^0-9A-Za-z]"),
        share(turns), flag(candidate.rlike("^[0-9a-f]+$")),
        F.regexp_count(low, F.lit("(?=" + "|".join(PAIRS) + ")")) / n,
        1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n,
        F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(32.0)),
        flag(before.rlike(SECRET_WORDS)), flag(near.rlike(DIGEST_WORDS)),
        flag(F.concat_ws(" ", candidate, near).rlike(PLACEHOLDER)), flag(candidate.rlike(PREFIX)),
        flag(before.rlike("[:=][ ]?[\"']?$")), flag(candidate.rlike("^[0-9]+$")),
        flag(F.coalesce(path, F.lit("")).rlike(SHY_PATH)), share("/"),
        flag(before.rlike("[\"'`]$")), flag(before.rlike("(?:^|[ \t\n/])[A-Za-z0-9_.-]*:$")), flag(candidate.rlike("^[A-Za-z]+$")),
        flag(candidate.rlike(r"[(){}<>$*\[\]]|^[a-z]+\.[A-Za-z.]+$")),
    )


def labelled_findings(spark: SparkSession, n: int = 4800, seed: int = 42) -> DataFrame:
    """(candidate, before, after, path, label): findings of known kinds, made by rule.

    Even kinds are secrets (1), odd ones look-alikes (0): digests, ids, card numbers,
    identifiers, paths, plain words, expressions and placeholders.
    """
    kinds = 36
    base = spark.range(0, n, 1, 4).select(
        (F.col("id") % kinds).cast("int").alias("k"),
        *(F.sha2(F.concat_ws(":", F.lit(f"{seed}{s}"), F.col("id")).cast("binary"), 256).alias(s) for s in "abc"),
    )
    number = lambda s, m: (F.conv(F.substring(s, 1, 8), 16, 10).cast("long") % m).cast("int")
    pick = lambda s, words: F.array(*map(F.lit, words))[number(s, len(words))]
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat("a", "b"))), "[+/=]", "7")
    upper = F.upper(F.translate(F.substring(mixed, 1, 16), "0189", "2345"))
    digits = F.regexp_replace(F.concat("a", "b", "c"), "[a-f]", "")
    word = lambda s: pick(s, DICTIONARY[:-10])
    plain = pick("c", ["and then the of ", "in the same way, ", "de la que ", "der und die ", "est un les. ", "here: "])
    asks = pick("c", ['token = "', "api_key: ", 'secret = "', "password=", "access_key = '", "pwd=", "Authorization: Bearer "])
    uuid = F.concat_ws("-", *(F.substring("a", p, k) for p, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    hex_of = lambda least, span: F.expr(f"substring(concat(a, b), 1, {least} + cast(conv(substring(c, 9, 4), 16, 10) as int) % {span})")
    hex40, plain_path = F.substring("a", 1, 40), pick("b", ["src3", "src/config.py", "settings.yml", "", "notes.txt", "deploy.sh"])
    shy = pick("b", ["tests/fixtures/data.json", "package-lock.json", "go.sum", "docs/example.md", "spec/mock.rb"])
    quoted = pick("c", ['password = "', "secret: '", 'pwd="', "db_password = '", '"auth_token": "'])
    bare = pick("c", ["token: ", "auth = ", "password: ", "secret=", "access_key: ", "credentials: "])
    address = pick("c", ["postgres://admin:", "https://bob:", "login root:", "amqp://svc.mail:"])
    sign, less = pick("c", ["&", "!", "#", "%", "^", "@1", "?", "~"]), lambda least, span: least + number("c", span)
    body = F.concat(F.substring(mixed, 1, 64), F.lit("\n"), F.substring(mixed, 5, 60), F.lit("\n"))
    rows = {
        24: (F.concat(word("a"), word("b"), word("c")), quoted, plain_path),
        26: (F.concat(F.substr(mixed, F.lit(1), less(3, 5)), sign, F.substr(mixed, F.lit(20), less(1, 4))), F.when(number("b", 2) == 0, quoted).otherwise(bare), plain_path),
        28: (F.concat(F.substr(mixed, F.lit(1), less(4, 10)), F.when(number("b", 2) == 0, F.lit("")).otherwise(pick("c", ["!", "#", "%", "$"]))), address, plain_path),
        30: (F.concat(F.lit("eyJ"), F.substring(mixed, 1, 17), F.lit("."), F.substring(mixed, 18, 40), F.lit("."), F.substring("b", 1, 43)), F.when(number("b", 2) == 0, asks).otherwise(plain), plain_path),
        32: (F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), body, F.lit("-----END PRIVATE KEY-----")), plain, plain_path),
        34: (F.concat(word("a"), number("b", 1000).cast("string")), quoted, plain_path),
        25: (word("a"), bare, plain_path),
        27: (pick("a", ["os.environ", "None", "null", "string", "str", "true", "self.token", "getpass()", "${DB_PASSWORD}", "process.env.TOKEN", "required", "********", "args.password", "input()"]), bare, plain_path),
        29: (pick("a", ["password", "pass", "PASSWORD", "${PASS}", "secret", "passwd", "$PASSWORD", "{password}", "****"]), address, plain_path),
        31: (F.concat(word("a"), word("b"), number("a", 90).cast("string"), F.lit("."), word("c"), word("a"), word("b")), plain, plain_path),
        33: (pick("a", ["changeme", "your_password", "<password>", "xxxxxx", "example", "dummy", "placeholder", "redacted", "your-secret", "********", "${TOKEN}"]), quoted, plain_path),
        35: (F.concat_ws("_", word("a"), word("b")), F.when(number("b", 2) == 0, quoted).otherwise(bare), plain_path),
        0: (hex40, asks, plain_path), 2: (hex_of(18, 30), asks, plain_path), 4: (F.concat(F.lit("AKIA"), upper), plain, plain_path),
        6: (F.substring(mixed, 1, 40), asks, plain_path), 8: (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), plain, plain_path),
        10: (F.lit("-----BEGIN RSA PRIVATE KEY-----"), plain, plain_path), 12: (F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), plain, plain_path),
        14: (F.concat(F.lit("xoxb-"), F.substring(digits, 1, 12), F.lit("-"), F.substring(mixed, 1, 24)), plain, plain_path),
        16: (F.concat(F.lit("AKIA"), upper), asks, plain_path), 18: (hex_of(16, 8), asks, plain_path),
        20: (F.concat(F.lit("AIza"), F.substring(mixed, 1, 35)), plain, plain_path), 22: (F.substring(mixed, 1, 24), asks, plain_path),
        1: (hex40, pick("c", ["commit ", "checksum: ", "sha1 = ", "revision=", "etag: \""]), plain_path),
        3: (F.col("a"), pick("c", ["sha256:", "digest = ", "integrity: "]), plain_path),
        5: (uuid, pick("c", ["id=", "uuid: ", "guid ", "see "]), plain_path),
        7: (F.substring(digits, 1, 16), plain, plain_path), 9: (F.concat_ws("_", word("a"), word("b"), F.concat(word("c"), number("a", 90).cast("string"))), plain, plain_path),
        11: (F.concat_ws("/", F.lit("src"), word("a"), F.concat(word("b"), number("b", 9).cast("string")), F.lit("index")), plain, plain_path),
        13: (F.concat(pick("a", ["example_", "your_", "dummy-", "sample_"]), pick("b", ["token_", "key_", "secret-"]), F.lit("1234567890")), asks, plain_path),
        15: (F.concat(word("a"), word("b"), word("c"), number("a", 100).cast("string")), plain, plain_path),
        17: (hex40, asks, shy), 19: (F.concat(F.lit("xxxxxxxxxxxx"), number("a", 10_000).cast("string")), asks, plain_path),
        21: (F.concat_ws("-", word("a"), word("b"), F.substring(digits, 1, 8)), plain, plain_path), 23: (F.substring(digits, 1, 14), asks, shy),
    }

    def by_kind(position: int) -> Column:
        out = None
        for k, values in rows.items():
            test = F.col("k") == k
            out = F.when(test, values[position]) if out is None else out.when(test, values[position])
        return out

    return base.select(
        by_kind(0).alias("candidate"), by_kind(1).alias("before"),
        pick("b", ['" and the', '" and commit ', "' with version ", "' in the "]).alias("after"),
        by_kind(2).alias("path"), (1 - F.col("k") % 2).alias("label"),
    )


@dataclass
class Forest:
    """Full trees of DEPTH levels in heap order: feature and threshold of the inner nodes,
    share of secrets at the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            votes += leaf[node - (2**DEPTH - 1)]
        return votes / len(self.leaf)

    def column(self, x: Column) -> Column:
        """The same as ``predict`` for a column of feature arrays."""
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        held = lambda a, kind: F.expr(f"cast(split('{','.join(map(repr, a.ravel().tolist()))}', ',') as array<{kind}>)")
        feature, threshold, leaf = held(self.feature, "int"), held(self.threshold, "double"), held(self.leaf, "double")

        def walk(tree: Column) -> Column:
            step = lambda node, _: node * 2 + 1 + (F.get(x, F.get(feature, tree * inner + node)) > F.get(threshold, tree * inner + node)).cast("int")
            return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), step)

        trees = F.sequence(F.lit(0), F.lit(len(self.leaf) - 1))
        return F.aggregate(trees, F.lit(0.0), lambda s, t: s + F.get(leaf, t * leaves + walk(t) - inner)) / len(self.leaf)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 42) -> Forest:
    """Bootstrap samples, a few random features a node, splits by Gini impurity."""
    rng = np.random.default_rng(seed)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    forest = Forest(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    tries = max(1, int(np.ceil(np.sqrt(x.shape[1]))) + 1)
    for t in range(trees):
        rows = {0: rng.integers(0, len(x), len(x))}
        for node in range(inner):
            own = rows.pop(node)
            best = (np.inf, 0, np.inf)
            if len(own) and 0 < y[own].mean() < 1:
                for f in rng.choice(x.shape[1], tries, replace=False):
                    order = own[np.argsort(x[own, f], kind="stable")]
                    v, ones = x[order, f], np.cumsum(y[order])
                    at = np.flatnonzero(v[1:] > v[:-1])
                    if len(at):
                        left, right = at + 1.0, len(own) - at - 1.0
                        a, b = ones[at], ones[-1] - ones[at]
                        gini = a * (left - a) / left + b * (right - b) / right
                        k = int(gini.argmin())
                        if gini[k] < best[0]:
                            best = (gini[k], int(f), float(v[at[k]] + v[at[k] + 1]) / 2)
            _, f, cut = best
            forest.feature[t, node], forest.threshold[t, node] = f, min(cut, 1e300)
            right = x[own, f] > cut if len(own) else np.zeros(0, bool)
            parts = (own[~right], own[right])
            for side in (0, 1):
                child = 2 * node + 1 + side
                part = parts[side] if len(parts[side]) else own if side == 0 else parts[side]
                if child < inner:
                    rows[child] = part
                else:
                    forest.leaf[t, child - inner] = y[part].mean() if len(part) else 0.0
    return forest


def train(labelled: DataFrame, most: int = FIT_FINDINGS) -> Forest:
    """A forest from (candidate, before, after, path, label) rows, at most ``most`` of them by
    a hash; rows without a candidate or a label of 0 or 1 don't count. Needs one row."""
    rows = labelled.where("candidate is not null AND label in (0, 1)").select(
        features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("path")).alias("x"),
        F.col("label").cast("int").alias("y"),
        F.xxhash64("candidate", "before", "after", "path").alias("h"),
    )
    held = rows.orderBy("h", "x", "y").limit(most).collect()
    if not held:
        raise ValueError("no labelled findings to learn from")
    return fit(np.array([r.x for r in held], float), np.array([r.y for r in held], float))


def judged(docs: DataFrame, forest: Forest, text_col: str, path_col: str | None, least: float) -> tuple[DataFrame, str, str]:
    """``docs`` with two arrays: the text cut before each candidate, and the findings."""
    parts, found, sizes, heads = (free_name(docs, c) for c in ("parts", "found", "piece_sizes", "run_heads"))
    clean = F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, "  ")
    marked = F.regexp_replace(clean, CANDIDATE, MARKED)
    cut = docs.withColumn(parts, F.split(marked, OPEN, -1))
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    own = lambda i: F.substring_index(F.get(F.col(parts), i), CLOSE, 1)
    rest = lambda i: F.substring_index(F.get(F.col(parts), i), CLOSE, -1)
    lengths = F.transform(F.col(parts), lambda p: F.length(F.replace(p, F.lit(CLOSE), F.lit(""))))
    # Offsets: lengths of all pieces before. Sums of whole runs of RUNS pieces are added up first,
    # so that a text with many candidates costs little more than its pieces.
    plus = lambda a, n: a + n
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUNS).cast("int")),
        lambda r: F.aggregate(F.slice(F.col(sizes), r * RUNS + 1, F.lit(RUNS)), F.lit(0), plus),
    )
    before = F.aggregate(runs, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    start = lambda i: F.get(F.col(heads), F.floor(i / RUNS).cast("int")) + F.aggregate(
        F.slice(F.col(sizes), F.floor(i / RUNS).cast("int") * RUNS + 1, i % RUNS), F.lit(0), plus
    )
    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    seen = F.transform(
        places,
        lambda i: F.struct(
            own(i).alias("candidate"), F.right(rest(i - 1), F.lit(BEFORE)).alias("before"),
            F.left(rest(i), F.lit(AFTER)).alias("after"), start(i).alias("start"),
        ),
    )
    described = F.transform(seen, lambda s: F.struct(s.alias("s"), features(s["candidate"], s["before"], s["after"], path).alias("x")))
    voted = F.transform(described, lambda d: F.struct(d["s"].alias("s"), forest.column(d["x"]).alias("p")))
    out = F.transform(
        voted,
        lambda v: F.struct(
            v["s"]["start"].alias("start"), (v["s"]["start"] + F.length(v["s"]["candidate"])).alias("end"),
            v["s"]["candidate"].alias("candidate"), v["s"]["before"].alias("before"),
            F.round(v["p"], 6).alias("probability"), (v["p"] >= least).alias("is_secret"),
        ),
    )
    cut = cut.withColumn(sizes, lengths)
    cut = cut.withColumn(heads, before)
    return cut.withColumn(found, F.when(F.size(parts) > 1, out)).drop(sizes, heads), parts, found


def scan(
    docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", least: float = 0.5
) -> DataFrame:
    """One row for each candidate: id, start, end (characters), candidate, before,
    probability, is_secret. Candidates that the forest rejects are kept with is_secret false.

    Null and empty texts have none. Rows that repeat give repeated findings; null ids stay
    null. Control characters U+0001 and U+0002 in a text count as blanks. Empty tables give
    an empty result; other columns don't matter.
    """
    named = {"scan_id": F.col(id_col), "scan_text": F.col(text_col)} | ({"scan_path": F.col(path_col)} if path_col else {})
    rows = docs.select(*(c.alias(k) for k, c in named.items()))
    out, _, found = judged(rows, forest, "scan_text", "scan_path" if path_col else None, least)
    each = out.select(F.col("scan_id").alias(id_col), F.explode(found).alias("finding"))
    return each.select(id_col, "finding.*")


def redact(
    docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]", least: float = 0.5
) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``; all rows and columns stay.
    Texts without a secret are unchanged, null stays null."""
    out, parts, found = judged(docs, forest, text_col, path_col, least)
    p, f = F.col(parts), F.col(found)
    piece = lambda x, i: F.when(
        (i > 0) & F.coalesce(F.get(f, i - 1)["is_secret"], F.lit(False)), F.concat(F.lit(mark), F.substring_index(x, CLOSE, -1))
    ).otherwise(F.replace(x, F.lit(CLOSE), F.lit("")))
    bad = F.coalesce(F.exists(f, lambda v: v["is_secret"]), F.lit(False))
    text = F.when(bad, F.array_join(F.transform(p, piece), "")).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*docs.columns)
