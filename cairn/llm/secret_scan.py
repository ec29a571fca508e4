"""Secret scan in DataFrame functions alone: candidate patterns, then a random forest against false positives.

Candidates are found by one pattern; the text around them comes from splitting by the same pattern. Features of value and
neighbourhood (length, character transitions, dictionary coverage, path shape, neighbouring words) go through a forest that
was trained with Spark ML on labelled findings and is walked by SQL array functions, so scoring is part of the scan.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.5
N_TRAIN = 6_000  # built-in labelled findings
TREES, DEPTH, SEED = 16, 6, 7
BEFORE, AFTER = 48, 24

_KEY = r"(?i:pass(?:word|wd|phrase)|pwd|(?:client[_-]?)?secret|token|(?:api|access|auth|private)[_-]?key|credentials?)"
_ASSIGN = _KEY + r"[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?"
_PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+){0,64}+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"  # headers of encrypted keys hold dashes
_JWT = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+"
_RUN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
CANDIDATE = f"{_PEM}|{_JWT}|{_ASSIGN}[^\\s\"'<>|,;]{{6,}}+|{_RUN}"
_HEAD = f"^{_ASSIGN}"

_WORDS = (
    "about above account action address admin alpha amount array author basic before begin between block board body book branch build button byte "
    "cache call card case change channel check class client clock code color column comment commit common config content context control copy count "
    "create current data date debug default delete detail device direct document domain double download draft edit element email empty error event "
    "example export extra false field file filter final first folder font form format from function gateway general get global graph group handle "
    "header height hello host image import index info input insert internal item java json label last layout length level library light line link list "
    "local lock login main manager map mark master max media member memory menu message method middle min mode model module month mount name native "
    "network next node none note null number object offset open option order output owner package page panel parent part path pattern person phone "
    "place player plugin point policy port position post prefix process product profile project property proxy public query queue random range read "
    "record region release remote report request reset resource response result return review right role root route router rule sample save scale "
    "schema scope screen script search section select sender server service session setting shadow share shop simple size sort source space spec "
    "stage start state static status step store stream string style submit suffix switch system table target task team temp template test text theme "
    "thread time title tool total track transfer tree trigger true type under unit update upload user util valid value version view virtual visit web "
    "width window with word work world write your tion ation ing ment able ness ough ther hand the and"
)
_DICT = "(?i:" + "|".join(sorted(_WORDS.split(), key=lambda w: (-len(w), w))) + ")"
_NEAR_YES = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|bearer|credential|login|signature|signing)[^\n]{0,24}$"
_NEAR_NO = r"(?i)(?:sha-?\d*|md5|commit|hash|checksum|digest|uuid|guid|revision|rev|build|version|etag|\bid|ref|isbn|phone|tel|card|order|invoice|blob|tree|parent|object)[^\n\w]{0,6}$"
_KNOWN = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|xox[abprs]-|AIza|eyJ|-----BEGIN|npm_|SG\.)"
_DUMMY = r"(?i)example|sample|dummy|changeme|change_me|placeholder|your|xxxx|0000000|1234567|abcdef[^0-9a-f]|redacted|\*\*\*|\$\{|\{\{|none$|null$|true$|false$"

FEATURES = (
    "length", "transitions", "runs", "digits", "upper", "lower", "symbols", "hex", "distinct", "dictionary", "vowels",
    "path", "assigned", "near_yes", "near_no", "known", "dummy",
)


def _share(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.greatest(F.length(value), F.lit(1))


def features(match: Column, before: Column, after: Column) -> Column:
    """Struct of FEATURES (doubles) plus value, key and match, of one candidate and its neighbourhood."""
    value = F.regexp_replace(match, _HEAD, "")
    n = F.greatest(F.length(value), F.lit(1))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "0")
    near = F.concat(before, F.regexp_extract(match, _HEAD, 0))
    cols = {
        "length": F.log1p(F.length(value).cast("double")),
        "transitions": F.regexp_count(shape, F.lit("a(?=[^a])|b(?=[^b])|0(?=[^0])|-(?=[^-])")) / n,
        "runs": F.regexp_count(value, F.lit(r"(.)(?=\1)")) / n,
        "digits": _share(value, "[0-9]"),
        "upper": _share(value, "[A-Z]"),
        "lower": _share(value, "[a-z]"),
        "symbols": _share(value, "[^A-Za-z0-9]"),
        "hex": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64)),
        "dictionary": _share(value, _DICT),
        "vowels": F.regexp_count(value, F.lit("(?i)[aeiouy][b-df-hj-np-tv-xz]")) / n,
        "path": (value.rlike(r"/[^/]+/|^[./~]|\.(?:com|org|net|html?|js|py|java|png|jpe?g|css|json|xml)\b") | before.rlike(r"[/.@\\]$") | after.rlike(r"^[/.@\\][A-Za-z]")).cast("double"),
        "assigned": match.rlike(_HEAD).cast("double"),
        "near_yes": near.rlike(_NEAR_YES).cast("double"),
        "near_no": near.rlike(_NEAR_NO).cast("double"),
        "known": value.rlike(_KNOWN).cast("double"),
        "dummy": value.rlike(_DUMMY).cast("double"),
    }
    return F.struct(match.alias("match"), value.alias("value"), *(cols[f].cast("double").alias(f) for f in FEATURES))


def candidates(text: Column) -> Column:
    """Array of (gap, features) of every candidate, in text order; gap is the text since the last one."""
    gaps, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    zipped = F.transform(
        found,
        lambda m, i: F.struct(
            F.get(gaps, i).alias("gap"),
            features(m, F.right(F.get(gaps, i), F.lit(BEFORE)), F.substring(F.coalesce(F.get(gaps, i + 1), F.lit("")), 1, AFTER)).alias("f"),
        ),
    )
    return F.when(text.rlike(CANDIDATE), zipped)


# -- labelled findings
def builtin_findings(spark: SparkSession, n: int = N_TRAIN, without: tuple[int, ...] = (), only: tuple[int, ...] | None = None) -> DataFrame:
    """text, label: generated findings, true secrets (1) and look-alikes (0), the same rows everywhere.

    without, only: kinds of finding by number (0 to 27, the first 14 secrets), for tests on kinds that were not trained on.
    """
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    g = F.sha2(F.concat(F.lit("second"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(h))
    url64 = F.translate(b64, "+/=", "-_")
    num = F.conv(F.substring(h, 1, 12), 16, 10)
    pick = lambda words, col, at: F.element_at(F.split(F.lit(words), " "), (F.conv(F.substring(col, at, 4), 16, 10).cast("int") % len(words.split()) + 1))
    some = lambda at: pick(_WORDS, g, at)
    key = pick("token password secret api_key access_key apikey auth_key client_secret API_KEY Token passwd private_key", g, 1)
    sep = pick('=" : =\' := :" =', g, 5)
    gap = F.when(F.substring(g, 9, 1) < "8", F.lit(" ")).otherwise(F.lit(""))
    lead, tail = F.concat_ws(" ", some(13), some(17), some(21)), F.concat_ws(" ", F.lit("\""), some(25), some(29))
    hexlen = F.element_at(F.array(*[F.lit(x) for x in (32, 40, 40, 48, 64)]), (F.conv(F.substring(g, 33, 2), 16, 10).cast("int") % 5 + 1))
    hexs = F.substring(h, F.lit(1), hexlen)
    assign = lambda v: F.concat(lead, F.lit(" "), key, gap, sep, gap, v, tail)
    said = lambda before, v: F.concat(lead, F.lit(" "), before, v, F.lit(" "), some(37))
    pw = F.concat(F.initcap(some(41)), F.substring(h, 1, 4), pick("! # % & _ - @", g, 45), F.initcap(some(49)), F.substring(num, 1, 3))
    yes = [
        assign(hexs), assign(hexs), assign(hexs), assign(F.substring(url64, 1, 32)), assign(b64), assign(pw), assign(F.substring(url64, 1, 20)),
        said(F.lit("AKIA"), F.upper(F.translate(F.substring(b64, 1, 16), "+/=", "XYZ"))), said(F.lit("ghp_"), F.translate(F.substring(b64, 1, 36), "+/=", "xYz")),
        said(F.lit("sk_live_"), F.translate(F.substring(b64, 1, 24), "+/=", "xYz")), said(F.lit("Authorization: Bearer "), F.substring(url64, 1, 40)),
        said(F.lit("eyJ"), F.concat(F.substring(url64, 1, 20), F.lit("."), F.translate(F.substring(url64, 5, 30), "=", "q"), F.lit("."), F.translate(F.substring(url64, 9, 24), "=", "w"))),
        said(F.lit(""), F.translate(F.substring(b64, 1, 40), "+/=", "/+a")), said(F.concat(key, F.lit(" ")), hexs),
    ]
    no = [
        said(F.lit("commit "), F.substring(h, 1, 40)), said(pick("sha1: md5: sha256: checksum= digest= etag: hash= revision build: blob tree", g, 1), F.concat(F.lit(" "), hexs)),
        said(F.lit(""), F.substring(h, 1, 32)), said(F.lit("uuid "), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))),
        said(F.lit("src/"), F.concat_ws("/", some(1), some(5), some(9), F.concat(some(33), F.substring(num, 1, 2)))), said(F.lit("https://www.shop.com/"), F.concat_ws("-", some(1), some(5), some(9), F.substring(num, 1, 4))),
        said(F.lit("card "), F.rpad(num, 16, "7")), said(F.lit("order "), F.rpad(num, 18, "3")), said(F.lit(""), F.concat_ws("_", some(1), some(5), some(9), F.substring(num, 1, 2))),
        assign(pick("your_api_key_here changeme123 example_token_1 xxxxxxxxxxxxxxxx ${SECRET_1} placeholder_12 dummy-token-123 sample_key_2024 12345678901234567890 0000000000000000", g, 53)),
        assign(F.concat_ws(".", some(1), some(5), some(9))), assign(F.concat_ws("_", some(1), some(5))), said(F.lit("on "), F.concat(F.lit("2024-01-02T03-"), F.substring(num, 1, 6))),
        said(F.lit(""), F.concat(F.lower(F.regexp_replace(F.concat(some(1), some(5), some(9), some(13), some(17)), "[^a-z]", "")), F.substring(num, 1, 1))),
    ]
    k = len(yes) + len(no)
    out = None
    for i, t in enumerate([*yes, *no]):
        if i in without or (only is not None and i not in only):
            continue
        # one small plan for each kind: a single CASE of all would not compile
        part = spark.range(i, n, k, 1).select(t.alias("text"), F.lit(float(i < len(yes))).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out.coalesce(1)


def fit_forest(findings: DataFrame) -> dict[str, list]:
    """Train on findings(text, label); the forest comes back as flat node lists, to be walked by SQL functions.

    The labelled findings are few and are trained in one partition in a fixed order, so the forest is the same everywhere.
    """
    rows = findings.repartition(1).select("label", F.explode(candidates(F.col("text"))).alias("c")).select("label", *(F.col(f"c.f.{f}").alias(f) for f in FEATURES))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.repartition(1).sortWithinPartitions("label", *FEATURES))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, featureSubsetStrategy="sqrt").fit(rows.select("label", "features"))
    out: dict[str, list] = {k: [] for k in ("root", "feature", "threshold", "left", "right", "value")}

    def add(node) -> int:
        at = len(out["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", 0.0)):
            out[k].append(v)
        if node.getClass().getSimpleName() == "LeafNode":  # a leaf leads to itself
            clean, secret = list(node.impurityStats().stats())
            out["value"][at] = secret / max(clean + secret, 1e-9)
        else:
            split = node.split()
            out["feature"][at], out["threshold"][at] = split.featureIndex(), split.threshold()
            out["left"][at] = add(node.leftChild())
            out["right"][at] = add(node.rightChild())
        return at

    for t in model.trees:
        out["root"].append(add(t._java_obj.rootNode()))
    return out


# -- operators
def scored(text: Column, forest: dict[str, list]) -> Column:
    """Array of (gap, match, value, score) of every candidate of a text; null without any."""
    return F.transform(candidates(text), lambda c: F.struct(c["gap"].alias("gap"), c["f"]["match"].alias("match"), c["f"]["value"].alias("value"), _apply(c["f"], forest).alias("score")))


def _apply(x: Column, forest: dict[str, list]) -> Column:
    """Mean over the trees of the leaf that the feature struct x comes to in DEPTH steps."""
    node = {k: F.array(*map(F.lit, v)) for k, v in forest.items()}
    at = F.array(*(x[f] for f in FEATURES))
    step = lambda n, _: F.when(F.get(at, F.get(node["feature"], n)) <= F.get(node["threshold"], n), F.get(node["left"], n)).otherwise(F.get(node["right"], n))
    leaf = F.transform(node["root"], lambda r: F.get(node["value"], F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), r, step)))
    return F.aggregate(leaf, F.lit(0.0), lambda a, b: a + b) / len(forest["root"])


def scan(docs: DataFrame, forest: dict[str, list], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, start, length (code points of the value in the whole text), kind, score, is_secret.

    Null and blank texts have no candidate; repeated rows are reported each. is_secret: the forest's score reaches the
    threshold. The texts are read once and only candidates are shuffled, to add up their places within their text.
    """
    from pyspark.sql import Window

    # the row number comes before the explode: in one select it would number the exploded rows
    found = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), scored(F.col(text_col), forest).alias("found"))
    hit = found.select("__id", "__row", F.posexplode("found").alias("i", "c"))
    flat = hit.select("__id", "__row", "i", F.length("c.gap").alias("g"), F.length("c.match").alias("m"), F.length("c.value").alias("v"), "c.value", F.col("c.score").alias("score"), F.col("c.match").rlike(_HEAD).alias("assigned"))
    upto = Window.partitionBy("__row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    kind = (
        F.when(F.col("value").rlike(r"^-----BEGIN"), "private_key").when(F.col("value").rlike(r"^eyJ[^.]*\."), "jwt").when(F.col("value").rlike(_KNOWN), "provider_key")
        .when(F.col("assigned"), "assignment").otherwise("token")
    )
    return flat.select(
        F.col("__id").alias(id_col), (F.sum(F.col("g") + F.col("m")).over(upto) - F.col("v")).alias("start"), F.col("v").alias("length"), kind.alias("kind"),
        F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"),
    )


def redact(docs: DataFrame, forest: dict[str, list], threshold: float = THRESHOLD, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found secret's value replaced by mark; no row goes, other columns stay as they are.

    n_chars, if there, follows the text. Null texts stay null.
    """
    text = F.col(text_col)
    pieces = F.transform(
        scored(text, forest),
        lambda c: F.concat(c["gap"], F.when(c["score"] >= threshold, F.concat(F.regexp_extract(c["match"], _HEAD, 0), F.lit(mark))).otherwise(c["match"])),
    )
    rest = F.element_at(F.split(text, CANDIDATE, -1), -1)
    new = F.when(text.rlike(CANDIDATE), F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    out = docs.withColumn(text_col, new)
    return out.withColumn("n_chars", F.coalesce(F.length(text_col).cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out
