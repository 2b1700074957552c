"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import quoted
from ..scratch import write_table

#: Labelled findings that the default forest is fitted on.
TRAIN_FINDINGS = 3_000
#: Characters kept on either side of a candidate as its neighbourhood.
NEAR = 64
#: Setting by which stages are compiled as a whole.
WHOLE_STAGE = "spark.sql.codegen.wholeStage"

# The names that secrets are assigned to, what tokens of services begin with, and patterns of secrets in Java's syntax. No length is cut; possessive loops need no stack.
_NAMES = "secret|token|password|passwd|passphrase|pwd|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?"
_SETS = r"[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}[\"'`]?"
_ASSIGNED = rf"(?i:(?:{_NAMES})[\w-]{{0,40}}+{_SETS})"
_ADDRESSED = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}+://[^\s:/@\"'<>]{0,128}+:"
_BEARER = r"(?i:\b(?:bearer|basic)[ \t]{1,4})"
_LEAD = f"(?:{_ADDRESSED}|{_ASSIGNED}(?:{_BEARER})?|{_BEARER})"
_VENDOR = r"(?:AKIA|ASIA|AIza|ya29\.|SG\.|eyJ|gh[opsur]_|github_pat_|glpat-|xox[abeoprs]-|[rs]k_live_|whsec_|npm_|pypi-|hf_|sk-|dop_v1_|shp(?:at|ss|ca)_|dckr_pat_)"
_VALUE = r"[^\s\"'`,;<>]{6,}+"
_LONG = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
_MARKED = rf"(?<![A-Za-z0-9+/_-]){_VENDOR}[A-Za-z0-9+/_.-]{{12,}}+={{0,2}}"
_PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]++|-(?!----))++-----END [A-Z ]{0,40}PRIVATE KEY-----"
PATTERN = rf"{_PEM}|{_ADDRESSED}[^\s/@\"'<>]{{3,}}+(?=@)|{_ASSIGNED}(?:{_PEM}|(?:{_BEARER})?{_VALUE})|{_BEARER}[A-Za-z0-9+/_.=~-]{{16,}}+|{_MARKED}|{_LONG}"
# Words that speak for prose, for a stand-in, for a digest and for a place of tests or of settings.
DICTIONARY = "about access account address after agent auth base before build cache case check class client code common config connection content count create current data database date default delete description device document domain email empty encode engine entry environment error event example export field file filter folder format from function group handler header home host html http image import index info input instance item json key language large last lib library line link list load local location login main manager message method model module name network node number object open option order output package page param parent parse part password path port process product project property public python query random read record reference remote request response result root route script search secret section select server service session setting shared size source start state status store string style system table target task template test text thread time title token type update upload user usr value version view width window with word world write".split()
STAND_INS = "changeme example placeholder dummy sample test your xxxx todo none null redacted insert secret_here foobar 12345 abcdef".split()
DIGEST_WORDS = "commit sha sha1 sha256 sha512 md5 md5sum sha1sum sha256sum checksum digest hash uuid guid revision etag integrity fingerprint blob tree".split()
TEST_PLACES, SETTING_PLACES = "test example sample mock fixture doc readme demo", "env config secret credential prod deploy setting"

FEATURES = (
    "length", "entropy", "distinct_share", "digit_share", "upper_share", "symbol_share", "kind_changes", "case_changes", "letter_pairs", "doubled",
    "dictionary", "stand_in", "calls", "assigned", "quoted", "digest_near", "secret_near", "test_place", "setting_place", "uuid", "vendor", "in_address", "bearer", "set_before", "mixed",
)


def _share(value: Column, pattern: str) -> Column:
    """Share of the characters of ``value`` that ``pattern`` covers."""
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def _per_char(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def _any(words: str | list[str]) -> str:
    return "|".join(words.split() if isinstance(words, str) else words)


def features(found: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of FEATURES and the value of a match, whose assigned name is not part of it."""
    value = F.regexp_replace(found, f"^{_LEAD}", "")
    lead = F.substring(found, F.lit(1), F.length(found) - F.length(value))
    chars = F.split(value, "")
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    count = lambda c: (n - F.length(F.replace(value, c))) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - count(c) * F.log2(F.greatest(count(c), F.lit(1e-9)))))
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), lead, F.lit(" "), F.left(after, F.lit(NEAR // 2))))
    place = F.lower(F.coalesce(path, F.lit("")))
    flag = lambda c: c.cast("double")
    made = {
        "length": F.log2(n), "entropy": entropy, "distinct_share": F.size(F.array_distinct(chars)) / n,
        "digit_share": _share(value, "[0-9]"), "upper_share": _share(value, "[A-Z]"), "symbol_share": _share(value, "[^A-Za-z0-9]"),
        "kind_changes": _per_char(value, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"), "case_changes": _per_char(value, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "letter_pairs": _per_char(value, "[aeiouyAEIOUY](?=[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ])|[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ](?=[aeiouyAEIOUY])"), "doubled": _per_char(value, r"(.)(?=\1)"),
        "dictionary": _share(F.lower(value), _any(sorted(DICTIONARY, key=len, reverse=True))), "stand_in": _share(F.lower(value), _any(STAND_INS)),
        "calls": flag(value.rlike(r"[(\[{$.]")), "assigned": flag(F.length(lead) > 0), "quoted": flag(lead.rlike("[\"'`]$")),
        "digest_near": flag(near.rlike(rf"\b(?:{_any(DIGEST_WORDS)})\b")), "secret_near": flag(near.rlike(_NAMES)), "test_place": flag(place.rlike(_any(TEST_PLACES))), "setting_place": flag(place.rlike(_any(SETTING_PLACES))),
        "uuid": flag(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "vendor": flag(value.rlike(f"^{_VENDOR}")), "in_address": flag(lead.contains("://")), "bearer": flag(lead.rlike(_BEARER + "$")), "set_before": flag(before.rlike(rf"[\w\]\)][\"']?[ \t]{{0,4}}(?::=|=>|=|: )[ \t]{{0,4}}[\"'`]?$")), "mixed": flag(value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")),
    }
    return F.struct(value.alias("value"), *(F.coalesce(made[c].cast("double"), F.lit(0.0)).alias(c) for c in FEATURES))


def labelled_findings(spark: SparkSession, n: int = TRAIN_FINDINGS) -> DataFrame:
    """Findings made by rule, for fitting where no own labelled findings are at hand: ``text``, ``path`` and ``label`` (1: a secret). Each text holds one candidate."""
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(of))) + 1).cast("int"))
    # draws are written first, so that the plan of the findings stays small
    sha = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    digests = [sha(k).alias(f"draw_{k}") for k in "hldxf"]
    letters = [F.regexp_replace(F.base64(F.unhex(sha(k))), "[\r\n=]", "").alias(f"b64_{k}") for k in "bprmgyoctjkux"]
    words = [pick(k, *DICTIONARY).alias(f"word_{k}") for k in ("w0", "w1", "w2", "w3", *"zabdefg")]
    draws = write_table(spark.range(0, n, 1, 8).select("id", *digests, *letters, *words), "draws")
    draw, b64, word = (lambda salt, kind=kind: F.col(f"{kind}_{salt}") for kind in ("draw", "b64", "word"))
    name = pick("n", "token", "secret", "api_key", "password", "access_key", "auth_key", "passwd", "API_KEY", "Token", "client_secret")
    gets = F.concat(name, pick("g", " = \"", ": \"", "=", ": ", " = '", " := \""))
    sets = F.concat(pick("e", "STRIPE", "aws", "MY", "service", "DB", "app", "X", "sendgrid", "slack"), pick("f", "_KEY", "_id", "_SIGNING", "_value", "Key", "_PASS", "_hook"), pick("g", "=", " = \"", ": \"", "=", ": "))
    plain = F.concat(pick("e", "video", "page", "build", "doc", "node", "user", "request", "cache", "font", "image"), pick("f", "_id", "", "_ref", "Url", "_path", "_name", "_hash", "_sha"), pick("g", "=", " = \"", ": \"", "=", ": "))
    prose = F.concat_ws(" ", *(word(f"w{k}") for k in range(4)))
    wrap = lambda c: F.concat(prose, F.lit(" "), c, pick("q", "\" ", "' ", " ", "\n"), word("z"))
    upper = F.substring(F.regexp_replace(F.upper(b64("u")), "[^A-Z0-9]", ""), 1, 16)
    secret = [
        F.concat(gets, F.substring(draw("h"), 1, 40)), F.concat(gets, F.substring(draw("h"), 1, 32)), F.concat(gets, F.substring(b64("b"), 1, 40)), F.concat(gets, F.substring(b64("b"), 1, 24)),
        F.concat(gets, F.substring(b64("p"), 1, 8), pick("s", "!", "#", "@", "%", "$"), F.substring(b64("r"), 1, 6)), F.concat(F.lit("AKIA"), upper), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64("g"), "[+/]", "x"), 1, 36)),
        F.concat(gets, draw("l")), F.concat(F.lit("eyJ"), b64("j"), F.lit("_"), b64("k")), F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(b64("y"), "[+/]", "q"), 1, 28)),
        F.concat(sets, F.substring(draw("h"), 1, 32)), F.concat(sets, F.substring(draw("h"), 1, 40)), F.concat(sets, draw("h")), F.concat(sets, F.substring(b64("b"), 1, 40)), F.concat(sets, F.lit("AKIA"), upper), F.concat(sets, F.substring(b64("m"), 1, 24)), F.concat(sets, F.lit("ghp_"), F.substring(F.regexp_replace(b64("g"), "[+/]", "x"), 1, 36)),
        F.concat(pick("v", "xoxb-", "xoxp-"), F.translate(F.substring(draw("d"), 1, 11), "abcdef", "012345"), F.lit("-"), F.substring(F.regexp_replace(b64("x"), "[+/]", "k"), 1, 20)), F.concat(pick("v", "xoxb-", "xoxa-"), F.translate(F.substring(draw("d"), 1, 10), "abcdef", "012345"), F.lit("-"), F.substring(F.translate(draw("x"), "0123456789", "ghijklmnop"), 1, 18)), F.concat(F.lit("glpat-"), F.substring(F.regexp_replace(b64("o"), "[+/]", "_"), 1, 20)),
        F.concat(pick("s", "postgres://", "mysql://", "amqp://", "https://", "mongodb+srv://"), word("a"), F.lit(":"), F.substring(F.regexp_replace(b64("c"), "[+/]", "z"), 1, 12), F.lit("@"), word("b"), F.lit("/"), word("d")), F.concat(pick("s", "postgres://", "redis://", "ftp://"), word("a"), F.lit(":"), word("e"), F.substring(draw("f"), 1, 1), word("g"), F.substring(F.translate(draw("f"), "abcdef", "012345"), 1, 2), F.lit("@"), word("b")),
        F.concat(pick("s", "Authorization: Bearer ", "bearer ", "Authorization: Basic "), F.substring(F.regexp_replace(b64("t"), "[+/]", "w"), 1, 36)),
    ]
    other = [
        F.concat(gets, pick("c", "changeme", "your_token_here", "xxxxxxxxxxxx", "example-password", "<api-key>", "${API_KEY}", "placeholder", "insert_secret_here", "dummy_token_123", "abcdef123456", "12345678")),
        F.concat(gets, word("a"), F.lit("_"), word("b"), F.lit("_"), word("d")), F.concat(gets, word("a"), F.lit("."), word("b"), F.lit("("), word("d"), F.lit(")")), F.concat(gets, F.lit("os.environ["), word("a"), F.lit("]")),
        F.concat(pick("c", "commit ", "sha1: ", "revision ", "tree "), F.substring(draw("h"), 1, 40)), F.concat(pick("c", "sha256: ", "checksum ", "digest "), draw("h")), F.concat(pick("c", "md5 ", "etag: ", "hash "), F.substring(draw("h"), 1, 32)),
        F.concat_ws("-", F.substring(draw("h"), 1, 8), F.substring(draw("h"), 9, 4), F.substring(draw("h"), 13, 4), F.substring(draw("h"), 17, 4), F.substring(draw("h"), 21, 12)), F.translate(F.substring(draw("h"), 1, 24), "abcdef", "012345"),
        F.concat(F.lit("/"), word("a"), F.lit("/"), word("b"), F.lit("3/"), word("d"), F.lit("-"), word("e"), F.lit("/"), word("f")), F.concat(word("a"), F.lit("_"), word("b"), F.lit("2_"), word("d"), F.lit("_"), word("e")), F.concat(gets, word("a"), word("b")),
        F.concat(plain, F.concat_ws("-", F.substring(draw("h"), 1, 8), F.substring(draw("h"), 9, 4), F.substring(draw("h"), 13, 4), F.substring(draw("h"), 17, 4), F.substring(draw("h"), 21, 12))), F.concat(pick("c", "commit=", "sha1=", "revision: ", "git_sha = \"", "tree: "), F.substring(draw("h"), 1, 40)), F.concat(pick("c", "sha256=", "integrity=\"sha256-", "digest: ", "etag=\""), draw("h")), F.concat(pick("c", "md5=", "checksum: ", "file_hash=", "fingerprint = "), F.substring(draw("h"), 1, 32)),
        F.concat(plain, word("a"), F.lit("-"), word("b"), F.lit("-"), word("d"), F.lit("-"), word("e"), F.lit("2")), F.concat(plain, F.lit("/"), word("a"), F.lit("/"), word("b"), F.lit("/"), word("d"), F.lit("-"), word("e"), F.lit("9")), F.concat(plain, word("a"), F.lit("_"), word("b"), F.lit("_"), word("d"), F.lit("_1"), word("e")), F.concat(plain, F.translate(F.substring(draw("h"), 1, 22), "abcdef", "012345")),
        F.concat(name, pick("f", "_count", "_type", "_limit", "_policy", "_file", "s_path"), pick("g", "=", ": ", " = "), pick("c", "1000000", "bearer", "default", "16384000", "enabled", "/etc/app/conf")), F.concat(pick("s", "postgres://", "https://", "redis://"), word("a"), F.lit(":"), pick("c", "password", "changeme", "${PASS}", "<password>", "your_password", "xxxx"), F.lit("@"), word("b")), F.concat(F.lit("the bearer of "), word("a"), F.lit(" "), word("b")), F.concat(pick("s", "Authorization: Bearer ", "bearer "), pick("c", "<your-access-token>", "your_token_goes_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "example-token-placeholder")),
    ]
    half = F.floor(F.col("id") / 2)
    choose = lambda kinds: F.element_at(F.array(*kinds), (F.pmod(half, F.lit(len(kinds))) + 1).cast("int"))
    is_secret = F.pmod("id", F.lit(2)) == 0
    path = pick("t", "src/app.py", "config/prod.env", "tests/test_app.py", "docs/readme.md", "deploy/settings.yaml", "", "crawl", "src3")
    made = draws.select(wrap(F.when(is_secret, choose(secret)).otherwise(choose(other))).alias("text"), path.alias("path"), is_secret.cast("double").alias("label"))
    # written here: a filter above would repeat the choice, which is too long for one compiled stage and is not worth the driver's trying
    before = spark.conf.get(WHOLE_STAGE)
    spark.conf.set(WHOLE_STAGE, "false")
    try:
        return write_table(made, "labelled")
    finally:
        spark.conf.set(WHOLE_STAGE, before)


def _matches(text: Column) -> Column:
    """An array of (found, before, after, start) of the candidates in a text, from those and the text between them. start counts code points from 0."""
    found, rest = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.split(text, PATTERN, -1)
    last = lambda a: F.element_at(a, -1)
    starts = F.aggregate(F.arrays_zip(rest.alias("r"), found.alias("f")), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(last(a) + F.length(x["r"]) + F.coalesce(F.length(x["f"]), F.lit(0)))))
    return F.transform(found, lambda f, i: F.struct(f.alias("found"), F.get(rest, i).alias("before"), F.get(rest, i + 1).alias("after"), (F.get(starts, i) + F.length(F.get(rest, i))).alias("start")))


def fit_forest(labelled: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel:
    """A forest on labelled findings (``text``, ``path``, ``label``). The first candidate of a text is the finding; texts without one are left out."""
    rows = labelled.where(F.col("text").rlike(PATTERN)).select(F.col("label").cast("double").alias("label"), "path", F.get(_matches(F.col("text")), F.lit(0)).alias("m"))
    rows = rows.select("label", features(F.col("m.found"), F.col("m.before"), F.col("m.after"), F.col("path")).alias("x")).select("label", "x.*")
    rows = write_table(rows, "findings")  # each level of the trees reads it
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))


def _score(model: RandomForestClassificationModel, x: Column) -> Column:
    """The forest over an array ``x`` of FEATURES: the share of its trees that vote for a secret. All trees lie in flat arrays of literals (feature, threshold, next place if at most it, next if over it, vote), so that the plan stays small; a walk goes down as many steps as the deepest tree has, a leaf leading to itself."""
    flat: list[list[float]] = []
    roots, deepest = [], 1
    for tree in re.split(r"(?m)^\s*Tree \d+.*$", model.toDebugString)[1:]:
        lines = iter([line.strip() for line in tree.splitlines() if line.strip()])

        def node(depth: int) -> int:
            nonlocal deepest
            line, at = next(lines), len(flat)  # noqa: B023  used within the loop's turn
            deepest = max(deepest, depth)
            if line.startswith("Predict:"):
                flat.append([0, 0.0, at, at, float(line.removeprefix("Predict:"))])
                return at
            test = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
            flat.append([int(test[1]), float(test[2]), 0, 0, 0.0])
            flat[at][2] = node(depth + 1)
            next(lines)  # noqa: B023  Else
            flat[at][3] = node(depth + 1)
            return at

        roots.append(node(0))
    feature, low, high = (F.lit(np.array([row[k] for row in flat], dtype=np.int32)) for k in (0, 2, 3))
    limit, vote = (F.lit(np.array([row[k] for row in flat], dtype=np.float64)) for k in (1, 4))
    walk = lambda v, root: F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), root, lambda at, _: F.when(F.get(v, F.get(feature, at)) <= F.get(limit, at), F.get(low, at)).otherwise(F.get(high, at)), lambda at: F.get(vote, at))
    votes = lambda v: F.aggregate(F.lit(np.array(roots, dtype=np.int32)), F.lit(0.0), lambda total, root: total + walk(v, root)) / float(len(roots))
    return F.get(F.transform(F.array(x), votes), F.lit(0))  # the features are put together once


def _scored(df: DataFrame, text: Column, path: Column, model: RandomForestClassificationModel) -> DataFrame:
    """``df`` with ``__found``: the candidates of a text with ``value``, ``start``, ``end`` and ``score``."""
    measured = F.transform(_matches(text), lambda m: F.struct(m["found"].alias("found"), m["start"].alias("start"), features(m["found"], m["before"], m["after"], path).alias("x")))
    size = lambda m: F.length(m["found"])
    named = lambda m: F.struct(m["x"]["value"].alias("value"), (m["start"] + size(m) - F.length(m["x"]["value"])).alias("start"), (m["start"] + size(m)).alias("end"), _score(model, F.array(*(m["x"][c] for c in FEATURES))).alias("score"))
    return df.withColumn("__measured", measured).withColumn("__found", F.transform("__measured", named)).drop("__measured")


def scan(df: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", at_least: float = 0.0) -> DataFrame:
    """A row for each candidate that scores ``at_least``: ``id_col``, ``value``, ``start``, ``end`` (code points, end excluded) and ``score`` (0 to 1).

    Null and empty texts have none; a null path says nothing. Repeated rows give repeated findings. Each row is worked on where it lies, without a shuffle.
    """
    path = F.col(quoted(path_col)).cast("string") if path_col else F.lit("")
    rows = df.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text_col)).alias("__text"), path.alias("__path")).where(F.col("__text").rlike(PATTERN))
    rows = _scored(rows, F.col("__text"), F.col("__path"), model).select(id_col, F.explode("__found").alias("m"))
    return rows.where(F.col("m.score") >= at_least).select(id_col, "m.value", "m.start", "m.end", "m.score")


def redact(df: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", path_col: str | None = "source", at_least: float = 0.5, mask: str = "<secret>") -> DataFrame:
    """``df`` with the values of all findings in ``text_col`` that score ``at_least`` replaced by ``mask``; null stays null. Only columns __measured and __found of ``df`` are lost."""
    text, path = F.col(quoted(text_col)), F.col(quoted(path_col)).cast("string") if path_col else F.lit("")
    has = F.coalesce(text.rlike(PATTERN), F.lit(False))
    kept = F.filter("__found", lambda m: m["score"] >= at_least)
    cut = F.aggregate(kept, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), lambda a, m: F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, m["start"] - a["at"]), F.lit(mask)).alias("done"), m["end"].alias("at")), lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text))))
    columns = [c for c in df.columns if c not in ("__measured", "__found")]
    mixed = _scored(df.select(*map(quoted, columns)).where(has), text, path, model).withColumn(text_col, cut).select(*map(quoted, columns))
    return df.select(*map(quoted, columns)).where(~has).unionByName(mixed)
