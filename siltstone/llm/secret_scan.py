"""Secret scans: candidates by pattern, false positives removed by a random forest, all on the JVM.

A candidate is a signed token (three parts between full stops), what is assigned to a secret's name (6 characters or more, of any
kind), or a run of 12 or more key characters with a digit in it; none has an upper bound. Its features are SQL expressions: length,
kinds of characters and transitions between them, distinct characters, how much of it dictionary pieces cover, signs of a path, and
the words next to it. The forest is trained from labelled findings: ``labelled_findings`` makes a fixed table of
real and false ones by rule (no documents are labelled for secrets); any table of its columns will do. It is bounded by its
row count, a parameter, and the scan covers every candidate of every whole text.

Defined cases: a null or empty text has no candidate; a candidate that a text repeats is judged at each of its places and is one
finding, with their count, the best score and the first place that has it; null ids and repeated rows are scanned like any; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEY = r"A-Za-z0-9+/_\-"
_NAME = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|auth[_-]?key|credentials?)"
#: What stands before an assigned value: a name, perhaps in quotes, a sign, perhaps a quote. The short look comes first, as it nearly always fails.
_GIVEN = rf"(?<=[=:]|[=:>][\"' ]|[=:>] [\"'])(?<=(?i:{_NAME})[\"']?[ \t]{{0,2}}[=:]>?[ \t]{{0,2}}[\"']?)"
_SIGNED = rf"(?<![{_KEY}.])eyJ[A-Za-z0-9_\-]{{8,}}+(?:\.[A-Za-z0-9_\-]+){{1,2}}"
_RUN = rf"(?<![{_KEY}])(?=[A-Za-z+/_\-]*+[0-9])[{_KEY}]{{12,}}+={{0,2}}(?![{_KEY}])"
CANDIDATE = rf"{_SIGNED}|{_GIVEN}[^\s\"'<>,;=]{{5,}}[^\s\"'<>,;.)\]}}]|{_RUN}"
BEFORE, AFTER = 40, 30

# Words beside secrets, words beside what only looks like one, pieces of ordinary words.
BESIDE_SECRETS = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization)\W{0,6}$"
BESIDE_OTHERS = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|etag|revision|uuid|guid|card|account|phone|isbn|order|invoice|serial|version|build|id|no|number)\W{0,6}$"
MADE_UP = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|your[_-]|test|1234|abcd|0000"
PIECES = r"(?i)the|ing|and|ion|ent|for|tion|ter|ver|ate|com|con|pro|per|able|ment|ness|file|name|user|data|page|index|image|http|www|lib|src|main|config|report|update|table|value"
FEATURES = ["f_parts", "f_kinds", "f_equals", "f_variable", "f_length", "f_digits", "f_upper", "f_lower", "f_turns", "f_distinct", "f_words", "f_hex", "f_slashes", "f_dashes", "f_groups", "f_prefix", "f_assigned", "f_quoted", "f_secret", "f_other", "f_made_up"]


def _share(candidate: Column, kept: str) -> Column:
    """The share of the characters that are in the class ``kept``."""
    return F.length(F.regexp_replace(candidate, f"[^{kept}]", "")) / F.greatest(F.length(candidate), F.lit(1))


def features(found: DataFrame) -> DataFrame:
    """The features of candidates (candidate, before, after), next to their columns."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    turns = sum((F.regexp_count(c, F.lit(p)) for p in ("[a-z](?=[0-9A-Z])", "[A-Z](?=[0-9a-z])", "[0-9](?=[A-Za-z])")), F.lit(0))
    kinds = sum((c.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    number = {
        "f_parts": c.rlike(r"^eyJ[\w-]+\.[\w-]+"),
        "f_kinds": kinds,
        "f_equals": before.rlike(r"=[ \t]*[\"']?$"),
        "f_variable": c.rlike(r"[${}()\[\]%]|^[*x.•]+$|\w\.\w+\."),
        "f_length": F.length(c),
        "f_digits": _share(c, "0-9"),
        "f_upper": _share(c, "A-Z"),
        "f_lower": _share(c, "a-z"),
        "f_turns": turns / F.length(c),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "f_words": 1 - F.length(F.regexp_replace(c, PIECES, "")) / F.length(c),
        "f_hex": c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$"),
        "f_slashes": F.regexp_count(c, F.lit("/")) + (before.rlike(r"[/.:\\]$") | after.rlike(r"^\.[a-z]{2,5}\b")).cast("int"),
        "f_dashes": F.regexp_count(c, F.lit("[_-]")),
        "f_groups": c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
        "f_prefix": c.rlike("^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bap]-|AIza|glpat-|npm_)"),
        "f_assigned": before.rlike(r"[=:]\s*[\"']?$"),
        "f_quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "f_secret": before.rlike(BESIDE_SECRETS),
        "f_other": before.rlike(BESIDE_OTHERS),
        "f_made_up": c.rlike(MADE_UP) | before.rlike(r"(?i)(example|sample|dummy|fake)\W{0,8}\w*\W{0,4}$"),
    }
    return found.select("*", *(F.coalesce(number[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, row, candidate, before, after, position): a row for each place of each candidate of each row of ``docs``.

    The texts between candidates give their neighbours and, summed up in order, their places, so a text is read once
    however many candidates it has; what is shuffled are the candidates alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("all"), F.split(text, CANDIDATE).alias("gaps")).where(F.size("all") > 0)
    found, gaps = F.col("all"), F.col("gaps")

    def one(i: Column) -> Column:
        before = F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i))
        after = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit("")))
        size = F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))
        return F.struct(i.alias("i"), F.get(found, i).alias("candidate"), size.cast("long").alias("size"), F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"))

    each = rows.select("doc_id", "row", F.inline(F.transform(F.sequence(F.lit(0), F.size(found) - 1), one)))
    upto = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.withColumn("position", F.sum("size").over(upto) + 1).drop("i", "size")


def labelled_findings(spark: SparkSession, n: int = 9_000) -> DataFrame:
    """(candidate, before, after, label): ``n`` real and false findings by rule, the same ones each time."""
    digest = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    base32 = F.upper(F.translate(F.base64(F.unhex(digest("b"))), "+/=01890", "QRSTUVWX"))
    base64 = F.translate(F.base64(F.unhex(digest("c"))), "=", "7")
    number = F.regexp_replace(F.base64(F.unhex(F.concat(digest("d"), digest("n")))), "[^0-9]", "")
    number = F.substring(F.concat(number, F.translate(digest("e"), "abcdef", "273849")), 1, 16)
    word = F.translate(F.substring(digest("w"), 1, 9), "0123456789abcdef", "aeiourstlnmdhgbc")
    twice = F.concat(word, F.lit("tion"), F.translate(F.substring(digest("v"), 1, 6), "0123456789abcdef", "aeiourstlnmdhgbc"))
    size = (F.col("id") % 13 + 12).cast("int")
    uuid = F.concat_ws("-", *(F.substring(digest("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    real = [
        (F.concat(F.lit("AKIA"), F.substring(base32, 1, 16)), "", ""),
        (F.substring(digest("p"), 1, size), " password=", ""),
        (F.substring(digest("t"), 1, 40), ' token = "', '"'),
        (F.substring(base64, 1, 40), ' secret_key: "', '"'),
        (F.substring(base64, 2, size + 4), " api_key=", ""),
        (F.concat(F.lit("ghp_"), F.substring(F.translate(base64, "+/", "xy"), 1, 36)), " Authorization: token ", ""),
        (F.concat(F.lit("sk_live_"), F.substring(F.translate(base64, "+/", "xy"), 1, 24)), " ", ""),
        (F.concat(F.initcap(F.substring(word, 1, 6)), (F.col("id") % 10).cast("string"), F.lit("!"), F.substring(digest("x"), 1, 2)), " password=", ""),
        (F.concat(word, F.substring(twice, 1, 9), F.substring(word, 2, 5)), ' password="', '"'),
        (F.concat(word, twice), " pwd: ", ""),
        (F.repeat(base64, 7), " api_key=", ""),
        (F.concat(F.lit("eyJ"), F.substring(base64, 1, 30), F.lit(".eyJ"), F.substring(base64, 5, 30), F.lit("."), F.substring(digest("y"), 1, 40)), " Bearer ", ""),
        (F.concat(F.lit("eyJ"), F.substring(base64, 1, 30), F.lit(".eyJ"), F.substring(base64, 5, 30), F.lit("."), F.substring(digest("y"), 1, 40)), " ", ""),
    ]
    false = [
        (number, "", ""),
        (number, " card number ", ""),
        (F.substring(digest("s"), 1, 40), " commit ", ""),
        (digest("h"), " sha256: ", ""),
        (F.substring(digest("m"), 1, 32), ' md5 = "', '"'),
        (uuid, " id: ", ""),
        (F.concat(twice, F.lit("_2024")), " ", " "),
        (F.concat_ws("/", word, twice, F.lit("v2")), " http://", ".html"),
        (F.concat(F.lit("your_api_key_"), F.lit("1234")), " token = ", ""),
        (F.concat(twice, (F.col("id") % 97).cast("string")), " ", ", "),
        (F.concat(F.lit("2024-01-15T10-30-"), (F.col("id") % 60).cast("string")), " ", ""),
        (F.concat(F.lit("xxxxxxxx"), F.lit("xxxx1234")), " password=", ""),
        (F.concat(word, F.lit("-"), number), " order ", ""),
        (F.concat(F.substring(word, 1, 5), F.lit("tion")), " password: ", ""),
        (F.concat(F.substring(word, 1, 4), F.lit("ing")), " token = ", ""),
        (F.concat(F.substring(word, 1, 6), F.lit("ed")), ' secret: "', '"'),
        (F.concat(F.lit("${"), F.upper(F.substring(word, 1, 6)), F.lit("_PASSWORD}")), " password=", ""),
        (F.concat(F.substring(word, 1, 5), F.lit("."), F.substring(word, 2, 5), F.lit(".token")), " token=", ""),
        (F.concat(F.lit("get_"), F.substring(word, 1, 5), F.lit("()")), " secret = ", ""),
        (F.concat(F.lit("AKIA"), F.substring(base32, 1, 9), F.lit("EXAMPLE")), " key ", ""),
        (F.concat(F.substring(base64, 1, 30), F.lit("EXAMPLEKEY")), ' secret_key = "', '"'),
        (F.lit("********"), " password: ", ""),
        (F.concat(F.lit("example"), word), " password=", ""),
    ]
    kinds = [(x, 1) for x in real] * 2 + [(x, 0) for x in false]
    made = F.array(*(F.struct(c.alias("candidate"), F.concat(word, F.lit(" "), F.lit(b) if b else F.lit(" ")).alias("before"), F.concat(F.lit(a), F.lit(" "), word).alias("after"), F.lit(y).alias("label")) for (c, b, a), y in kinds))
    rows = spark.range(0, n, 1, 4)
    return rows.select(F.element_at(made, (F.col("id") % len(kinds) + 1).cast("int")).alias("r"), "id").select("r.*", "id")


def train(findings: DataFrame, trees: int = 20, depth: int = 8, seed: int = 7) -> PipelineModel:
    """A forest over the features of labelled findings."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings)).select("features", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    return PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features"), forest])


def judge(found: DataFrame, model: PipelineModel) -> DataFrame:
    """``found`` with the score, in 0 to 1, that a candidate is a secret."""
    scored = model.transform(features(found))
    return scored.select(*found.columns, F.round(F.element_at(vector_to_array("probability"), 2), 6).alias("score"))


_TRAINED: dict[str, PipelineModel] = {}


def standard(spark: SparkSession) -> PipelineModel:
    """The forest of the fixed findings, trained once in a session."""
    own = spark.sparkContext.applicationId
    if own not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[own] = train(labelled_findings(spark))
    return _TRAINED[own]


def scan(docs: DataFrame, model: PipelineModel | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, kind, position, n_chars, occurrences, secret_sha256 and score of every finding that the forest keeps."""
    judged = judge(candidates(docs), model or standard(docs.sparkSession))
    best = F.max_by(F.struct("score", "position", "before"), F.struct("score", -F.col("position"))).alias("b")
    kept = judged.groupBy("row", "doc_id", "candidate").agg(best, F.count("*").alias("occurrences")).where(F.col("b.score") >= threshold)
    c, before = F.col("candidate"), F.lower("b.before")
    kind = F.when(c.rlike("^(AKIA|ASIA)"), "access key id").when(c.rlike("^(ghp_|gho_|glpat-|npm_|xox|sk)"), "service token").when(c.rlike(r"^eyJ[\w-]+\."), "signed token")
    kind = kind.when(before.rlike("passw|pwd"), "password").when(before.rlike("token|bearer"), "token").otherwise("key")
    return kept.select("doc_id", kind.alias("kind"), F.col("b.position").alias("position"), F.length(c).cast("long").alias("n_chars"), "occurrences", F.sha2(c, 256).alias("secret_sha256"), F.col("b.score").alias("score"))
