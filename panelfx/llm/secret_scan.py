"""Secret scans: candidates by pattern, false positives removed by a random forest. Native expressions only.

Candidates are long tokens of keys and hashes, values assigned to a name such as ``password``, and passwords in URLs.
The forest is fitted by Spark ML on labelled findings (a bounded table) and compiled into a conditional
expression, so that candidates are found, described and judged within a document's own row: there is no
join, no shuffle and no Python on the executors. The work is linear in a text's length, but for a sort of its places.
"""

from __future__ import annotations

import random
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that secrets are assigned to.
KEYS = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth|credentials?)"
#: A value of six characters or more behind such a name; the cheap tests of what stands before come first.
ASSIGNED = rf"""(?<=[=:"' ])(?<=[=:][ "']{{0,2}})(?<=(?i:{KEYS}(?:_?[a-z]{{1,6}})?)["']?\x20?[=:]\x20?["']?)[^\s"'`,;<>(){{}}\[\]]{{5,127}}[^\s"'`,;<>(){{}}\[\].!?:]"""
#: What stands between a user's name and the host of a URL.
IN_URL = r"""(?<=:)(?<=://[A-Za-z0-9._%+\-]{1,40}:)[^\s"'/:@]{3,64}(?=@)"""
#: 16 characters or more of keys and hashes, with a digit or else all capitals.
TOKEN = r"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/_.\-]*[0-9]|[A-Z]{16})[A-Za-z0-9+/_.\-]{16,}={0,2}"
CANDIDATE = f"{IN_URL}|{ASSIGNED}|{TOKEN}"
LEFT, RIGHT = 48, 24
MASK = "[SECRET]"
#: Parts of tokens of so many letters and digits are looked up among the tokens found.
LEAST_PART = 12
#: Words that mark a token as prose, a placeholder or an identifier.
DICTIONARY = (
    "example sample dummy placeholder changeme test demo default your insert here password secret token user name "
    "file path index image photo article page news item list data table report version release build branch commit "
    "update message request response client server config module package library function class object value number "
    "string color width height style script public private static final return import export january february march "
    "april june july august september october november december monday tuesday wednesday thursday friday "
    "required optional missing invalid expired empty field input output login account reset change forgot please enter "
    "provided stored hashed generate generated session cookie header policy rotate system admin house water people world "
    "small large first second third after before about other their there which would could should these those"
).split()
COMMON_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
FEATURES = ("length", "digits", "transitions", "hex", "distinct", "dictionary", "pairs", "segments", "in_path", "key_word", "assigned", "other_word", "prefix", "quoted", "in_url", "kinds", "plain", "reference")
TREES, DEPTH = 32, 7
#: Labelled findings used in fitting.
MOST_FINDINGS = 50_000


def features(token: Column, left: Column, right: Column) -> dict[str, Column]:
    n = F.greatest(F.length(token), F.lit(1)).cast("double")
    low = F.lower(token)
    flag = lambda c: c.cast("double")
    return {
        "length": n,
        "digits": F.regexp_count(token, F.lit("[0-9]")) / n,
        "transitions": F.regexp_count(token, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / n,
        "hex": flag(token.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(DICTIONARY), "")) / n,
        "pairs": F.regexp_count(low, F.lit("|".join(COMMON_PAIRS))) / n,
        "segments": F.regexp_count(token, F.lit(r"[/.\-]")) / n,
        "in_path": flag(left.rlike(r"(://\S*|/|\\)$") | right.rlike(r"^(/|\\|\.[a-z]{2,4}\b)") | token.rlike(r"\.[a-z]{2,4}$|^/|/\w+/")),
        "key_word": flag(left.rlike(r"(?i)(passw|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private.?key)[^\n]{0,16}$")),
        "assigned": flag(left.rlike(r"""[=:]\s*["']?$""")),
        "other_word": flag(left.rlike(r"(?i)(commit|revision|sha\d*|md5|hash|digest|checksum|etag|uuid|guid|isbn|build|version|ref|example|sample|dummy|order|invoice|serial)[^\n]{0,12}$")),
        "prefix": flag(token.rlike("^(AKIA|ASIA|AIza|ghp_|gho_|glpat-|sk_live_|rk_live_|xox[abprs]-|eyJ)")),
        "quoted": flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        "in_url": flag(left.rlike(r"://[^\s/@]*:$") & right.startswith("@")),
        "kinds": reduce(lambda a, b: a + b, [flag(token.rlike(p)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]),
        "plain": flag(token.rlike(r"^[A-Za-z]?[a-z]+([_\-.][A-Za-z]?[a-z]+)*$")),
        "reference": flag(token.rlike(r"^[$%]|^(\*+|[xX.\-_]+)$|^(?i:none|null|true|false|undefined|redacted|hidden)$|^(process|os|self|this|config|settings|env|request|args|params)\.") | right.rlike(r"^[(\[]|^\{|^ *<")),
    }


def default_findings(n: int = 8000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Labelled findings ``(left, token, right, label)`` made by rule: secrets in use, and what resembles them."""
    r = random.Random(seed)
    hexd, b64, caps = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: r.choice(DICTIONARY)
    made = lambda lo=2, hi=9: pick("etaoinshrdlu", r.randint(lo, hi))
    prose = lambda: " ".join(made() for _ in range(r.randint(1, 4)))
    setter = lambda *names: f"{r.choice(names)}{r.choice(['=', ': ', ' = ', ':'])}"
    names = ("password", "passwd", "pwd", "secret", "token", "auth_token", "api_key", "apikey", "access_key", "passphrase")

    def chosen() -> str:
        """What people choose: a word or two with digits or marks in, at an end or in place of letters."""
        base = r.choice([word(), made(4, 8)])
        base = r.choice([base, base.capitalize(), base.replace("o", "0").replace("e", "3").replace("a", "4") + r.choice(["", "x7"])])
        extra = r.choice([str(r.randint(1, 99999)), r.choice("!@#$%&*") + str(r.randint(0, 99)), str(r.randint(0, 9)) + r.choice("!@#$%&*"), str(r.randint(0, 9)) + made(3, 5) + str(r.randint(0, 9))])
        return (base + extra) if len(base + extra) >= 6 else base + extra + pick("0123456789", 4)

    out = []
    for i in range(n):
        quote = r.choice(['"', "'", "", ""])
        lead, tail = prose() + " ", " " + prose()
        kind = i % 20
        if kind == 0:
            row = (lead + r.choice(["", "key ", "aws_access_key_id="]), r.choice(["AKIA", "ASIA"]) + pick(caps, 16), tail, 1)
        elif kind == 1:
            row = (lead + setter(*names) + quote, pick(hexd, r.randint(12, 32)), quote + tail, 1)
        elif kind == 2:
            row = (lead + setter(*names) + quote, pick(hexd, r.choice([32, 40, 40, 64])), quote + tail, 1)
        elif kind == 3:
            row = (lead + setter("secret", "api-key", "apikey", "private_key", "Bearer") + quote, pick(b64, r.randint(20, 44)), quote + tail, 1)
        elif kind == 4:
            row = (lead, r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"]) + pick(b64[:62], r.randint(20, 36)), tail, 1)
        elif kind in (5, 6, 7):
            row = (lead + setter(*names) + quote, chosen(), quote + tail, 1)
        elif kind in (8, 9):
            user = r.choice(["root", "admin", "app", made(3, 7)])
            row = (lead + f"{r.choice(['postgres', 'mysql', 'https', 'redis', 'amqp', 'mongodb'])}://{user}:", r.choice([chosen(), pick(b64[:62], r.randint(8, 20)), made(6, 9)]), f"@{made()}.{made(2, 3)}/{made()}" + tail, 1)
        elif kind == 10:
            row = (lead + r.choice(["commit ", "sha256: ", "md5 ", "etag=", "revision ", "checksum: ", "digest = "]) + quote, r.choice([pick(hexd, r.choice([32, 40, 64])), pick(b64, r.randint(24, 64)), "md5-" + pick(b64, 22)]), quote + tail, 0)
        elif kind == 11:
            row = (lead + r.choice(["uuid ", "id=", "", "guid: "]), "-".join(pick(hexd, k) for k in (8, 4, 4, 4, 12)), tail, 0)
        elif kind == 12:
            row = (lead + r.choice(["/", "http://host/", "src/", "img="]), "/".join(word() for _ in range(r.randint(2, 4))) + f"/{r.choice([word() + str(r.randint(1, 999)), pick(hexd, 16)])}.{r.choice(['png', 'html', 'py'])}", tail, 0)
        elif kind == 13:
            row = (lead + setter(*names) + quote, r.choice(["your", "example", "dummy", "changeme", "test", "my", "insert"]) + r.choice("_-") + word() + r.choice(["", "_" + word(), "_here", str(r.randint(1, 9999))]), quote + tail, 0)
        elif kind == 14:
            row = (lead, "AKIA" + pick("X", 5) + "EXAMPLE" + pick("0123456789", 4), tail, 0)
        elif kind == 15:
            row = (lead, r.choice([f"{word()}-{word()}-{word()}-20{r.randint(10, 29)}-{r.randint(1, 12)}", f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}.{r.randint(10, 59)}.{r.randint(10, 59)}Z"]), tail, 0)
        elif kind == 16:
            row = (lead + r.choice(["", "", f"{made()}={quote}", f"{made()}: {quote}"]), r.choice([made(14, 22) + str(r.randint(0, 99)), pick(b64, r.randint(24, 60))]), tail, 0)
        elif kind == 17:
            row = (lead + setter(*names) + quote, r.choice([word(), made(6, 11), word() + r.choice("_-.") + word()]), quote + tail, 0)
        elif kind == 18:
            held = r.choice([("${" + word().upper(), "}"), ("$" + word().upper() + "_" + word().upper(), ""), ("process.env." + word().upper(), ""), ("os.environ", "["), ("os.getenv", "("), ("get_" + word(), "("), ("self." + word(), ""), ("config." + word() + "_" + word(), "")])
            row = (lead + setter(*names) + quote, held[0], held[1] + quote + tail, 0)
        else:
            row = (lead + setter(*names) + quote, r.choice(["*" * r.randint(6, 12), "x" * r.randint(6, 20), "XXXXXX-XXXX", "undefined", "REDACTED", "hidden", "<" + word(), "....."]), quote + tail, 0)
        out.append(row)
    return out


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list:
    """A random forest as nested tuples ``(feature, threshold, low, high)`` with leaves 0.0 or 1.0.

    ``findings(left, token, right, label)``: rows with a null token or label are left out, null
    context is empty. At most MOST_FINDINGS rows, those of least hash, are used.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.where("token IS NOT NULL AND label IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("left", "token", "right"), "label").limit(MOST_FINDINGS)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = rows.select(F.col("label").cast("double").alias("label"), *[c.alias(k) for k, c in features(F.col("token"), empty("left"), empty("right")).items()]).persist()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=False).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made))
    made.unpersist()
    return [_parse(iter(t.toDebugString.splitlines()[1:])) for t in model.trees]


def _parse(lines) -> tuple | float:
    line = next(lines).strip()
    if m := re.match(r"Predict: ([\d.]+)", line):
        return float(m[1])
    m = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line)
    low = _parse(lines)
    next(lines)  # the matching Else
    return FEATURES[int(m[1])], float(m[2]), low, _parse(lines)


def forest_sql(forest: list, described: str) -> str:
    """The share of trees that vote for a secret, as a conditional SQL expression on a struct of features. Parsed at once: built node by node it takes longer than a small scan."""

    def node(t) -> str:
        if isinstance(t, float):
            return f"{t!r}D"
        return f"CASE WHEN {described}.{t[0]} <= {t[1]!r}D THEN {node(t[2])} ELSE {node(t[3])} END"

    return f"({' + '.join(map(node, forest))}) / {len(forest)}D"


def scan(docs: DataFrame, forest: list, text_col: str = "text", least_votes: float = 0.5, prefix: str = "secret_") -> DataFrame:
    """``docs`` and, with ``prefix``: candidates (token, votes), found (tokens), and text (redacted).

    Every place of a token is judged with its own context, and its votes are those of the place with most;
    a token found at any of its places is redacted at all places where it stands as a candidate or as a whole part of
    one, and nowhere within longer runs of letters and digits. A null text stays null with no candidates, an empty one stays empty. Texts are scanned
    whole; equal texts get equal results. Columns of ``docs`` with a clashing name are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<int>")
    names = [prefix + k for k in ("candidates", "found", "text")]
    # what lies between the places: one piece more than there are tokens
    out = docs.withColumn("_tokens", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).withColumn("_between", F.split(text, CANDIDATE, -1))

    def describe(t: Column, i: Column) -> Column:
        # neighbours fill a window only where they stand close together
        piece = lambda name, k: F.coalesce(F.get(name, i + k), F.lit(""))
        left = [F.right(c, F.lit(LEFT)) for k in range(-4, 0) for c in (piece("_tokens", k), piece("_between", k + 1))]
        right = [F.left(c, F.lit(RIGHT)) for k in range(3) for c in (piece("_between", k + 1), piece("_tokens", k + 1))]
        return F.struct(t.alias("token"), F.right(F.concat(*left), F.lit(LEFT)).alias("left"), F.left(F.concat(*right), F.lit(RIGHT)).alias("right"))

    out = out.withColumn("_places", F.transform("_tokens", describe))
    out = out.withColumn("_described", F.transform("_places", lambda p: F.struct(*[c.cast("double").alias(k) for k, c in features(p["token"], p["left"], p["right"]).items()])))
    out = out.withColumn("_votes", F.expr(f"transform(_described, d -> {forest_sql(forest, 'd')})"))
    # entries: each place (k 0) and the long parts of its token (k from 1, without votes of their own); those of one string form a run, most votes first
    entry = lambda t, v, i, k: F.struct(t.alias("t"), v.alias("v"), i.alias("i"), k.alias("k"))
    parts = lambda t: F.filter(F.split(t, "[^A-Za-z0-9]+"), lambda x: (F.length(x) >= LEAST_PART) & (x != t))
    # votes come along as an argument: a column that a lambda looks up only once would be computed anew at each place
    scored = F.zip_with("_tokens", "_votes", lambda t, v: F.struct(t.alias("t"), v.alias("v")))
    entries = F.transform(scored, lambda x, i: F.concat(F.array(entry(x["t"], -x["v"], i, F.lit(0))), F.transform(parts(x["t"]), lambda y, k: entry(y, F.lit(1.0), i, k + 1))))
    out = out.withColumn("_runs", F.sort_array(F.flatten(entries)))
    n = F.size("_runs")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    out = out.withColumn("_starts", F.filter(every, lambda k: (k == 0) | (F.get("_runs", k - 1)["t"] != F.get("_runs", k)["t"])))
    run = lambda s, k: F.slice("_runs", s + 1, F.coalesce(F.get("_starts", k + 1), n) - s)
    first = lambda s, k: F.array_min(F.transform(F.filter(run(s, k), lambda r: r["k"] == 0), lambda r: r["i"]))
    judged = F.transform("_starts", lambda s, k: F.struct(first(s, k).alias("at"), F.get("_runs", s)["t"].alias("token"), (-F.get("_runs", s)["v"]).alias("votes")))
    out = out.withColumn("_judged", F.filter(judged, lambda j: j["votes"] >= 0))
    # and back to the order of places: a run's best votes count at all of its entries
    best = F.flatten(F.transform("_starts", lambda s, k: F.transform(run(s, k), lambda r: F.struct(r["i"].alias("i"), r["k"].alias("k"), r["t"].alias("t"), (-F.get("_runs", s)["v"]).alias("v")))))
    out = out.withColumn("_best", F.sort_array(best))
    out = out.withColumn("_firsts", F.filter(every, lambda k: F.get("_best", k)["k"] == 0))
    out = out.withColumn(names[0], F.transform(F.sort_array("_judged"), lambda j: F.struct(j["token"].alias("token"), j["votes"].alias("votes"))))
    out = out.withColumn(names[1], F.transform(F.filter(names[0], lambda c: c["votes"] >= least_votes), lambda c: c["token"]))

    def mask(t: Column, i: Column) -> Column:
        at = F.get("_firsts", i)
        inner = F.filter(F.slice("_best", at + 2, F.coalesce(F.get("_firsts", i + 1), n) - at - 1), lambda e: e["v"] >= least_votes)
        whole = F.get("_best", at)["v"] >= least_votes
        bound = lambda x: F.concat(F.lit("(?<![A-Za-z0-9])"), x, F.lit("(?![A-Za-z0-9])"))
        return F.when(whole, F.lit(MASK)).when(F.size(inner) > 0, F.aggregate(inner, t, lambda acc, e: F.regexp_replace(acc, bound(e["t"]), F.lit(MASK)))).otherwise(t)

    clean = F.concat(F.array_join(F.transform("_tokens", lambda t, i: F.concat(F.get("_between", i), mask(t, i))), ""), F.element_at("_between", -1))
    out = out.withColumn(names[2], F.when(F.size(names[1]) > 0, clean).otherwise(F.col(text_col)))
    return out.drop("_tokens", "_between", "_places", "_described", "_votes", "_runs", "_starts", "_judged", "_best", "_firsts")


def default_forest(spark: SparkSession) -> list:
    return fit(spark.createDataFrame(default_findings(), "left string, token string, right string, label int"))
