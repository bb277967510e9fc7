"""Secret scan with DataFrame functions only: candidates by pattern, false positives out by a random forest.

The forest judges a candidate by its length, character transitions, dictionary coverage, the path
(source) and the words around it. It is trained from labelled findings: a table of (word, before2,
before1, after1, source, label); labelled_findings() builds one of known kinds of secrets and of
their usual look-alikes, and any table of reviewed findings can take its place.
"""

from __future__ import annotations


from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.session import let

LEAST = 16
TREES, DEPTH, SEED = 30, 8, 17
FINDINGS = 6_000
_SIGNS = "[A-Za-z0-9_+/=.~-]"
#: A run (2) with the signs since the last one and the name (1) that it is assigned to.
_RUN = f"""(?s).*?(?:([A-Za-z_.-]+)["']?[=:]["']*)?({_SIGNS}{{{LEAST},}})"""
#: Frequent words and parts of identifiers; what a candidate holds of them is covered by the dictionary.
DICTIONARY = (
    "access account action address admin alpha and app archive array async author available base beta block branch buffer build button bytes cache call "
    "cell change channel check class client cloud code color column com command common component config connect console content context control core count "
    "create current data date default delete design detail device dev director display document domain download edit element email enable engine entry error "
    "event example export factory feature field file filter final find first folder form format frame function get group handler hash head height home host "
    "http icon image import index info input instance item java job join json key label language layer layout length level library line link list listener "
    "load local location lock log login long main manager map mark master max media member memory menu message meta method min mobile mode model module "
    "monitor month name network node none note null number object offset one open option order org output package page panel param parent part password "
    "path plugin point policy pool port position post process product profile project property proxy public query queue range read record region register "
    "release remote report request resource response result role root route rule run sample scale schema scope screen script search section secret select "
    "sender server service session set setting share size source stage start state static status step storage store stream string style summary sync system "
    "table tag target task template test text the thread time title token tool top total track transaction tree type unit update upload uri url user util "
    "value version video view web width window worker write www xml year zone"
)
WARNING = "token|secret|passw|pwd|api_?-?key|apikey|auth|credential|bearer|private|access_?-?key|client_?-?key|signing"
HARMLESS = "commit|checksum|sha-?1|sha-?256|md5|digest|etag|uuid|guid|revision|version|build|integrity|fingerprint|ref|image|file|see"
SAMPLE_PATH = "test|example|sample|fixture|mock|demo|doc"


def candidates(docs: DataFrame) -> DataFrame:
    """Candidates of docs(doc_id, text, source): doc_id, source, word_index, run_index, word, name, core, before2, before1, after1.

    Candidates (core) are all runs of 16 signs or more of a key alphabet in a word (between ASCII
    white space) that has a digit and a letter, or both cases. name is what a run is assigned to;
    word is the part of the word since the run before. Null and empty texts have none.
    """
    def around(ws: Column) -> Column:
        word = lambda i: F.get(ws, i)
        near = lambda i: F.coalesce(word(i), F.lit(""))
        places = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (F.length(word(i)) >= LEAST) & _key_like(word(i)))
        return F.transform(
            places,
            lambda i: F.struct(
                i.cast("long").alias("word_index"), word(i).alias("word"), near(i - 2).alias("before2"), near(i - 1).alias("before1"), near(i + 1).alias("after1")
            ),
        )

    split = F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")
    each = docs.select("doc_id", "source", F.explode(let(split, around)).alias("c"))
    found = each.select("doc_id", "source", "c.*").withColumns({f"_{i}": F.regexp_extract_all("word", F.lit(_RUN), F.lit(i)) for i in range(3)})
    runs = found.select("*", F.posexplode(F.arrays_zip("_0", "_1", "_2")).alias("run_index", "run"))
    return runs.select(
        "doc_id", "source", "word_index", F.col("run_index").cast("long").alias("run_index"), F.when(F.size("_0") == 1, F.col("word")).otherwise(F.col("run._0")).alias("word"),
        F.col("run._1").alias("name"), F.col("run._2").alias("core"), "before2", "before1", "after1",
    )


def _key_like(word: Column) -> Column:
    return word.rlike(f"{_SIGNS}{{{LEAST}}}") & word.rlike("[0-9]") & word.rlike("[A-Za-z]") | (word.rlike(f"{_SIGNS}{{24}}") & word.rlike("[a-z]") & word.rlike("[A-Z]"))


def featured(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """found with core, the candidate string (the first run of word, if found has none), and the features of the forest; the names of these."""
    rows = found
    if "core" not in found.columns:
        rows = rows.withColumn("name", F.regexp_extract("word", _RUN, 1)).withColumn("core", F.regexp_extract("word", _RUN, 2))
        rows = rows.withColumn("core", F.when(F.col("core") == "", F.col("word")).otherwise(F.col("core")))
    n = F.greatest(F.length("core"), F.lit(1))
    share = lambda pattern: F.regexp_count("core", F.lit(pattern)) / n
    words = "|".join(sorted((w for w in DICTIONARY.split() if len(w) > 2), key=lambda w: (-len(w), w)))
    context = F.lower(F.concat_ws(" ", "before2", "before1", "name"))
    columns = {
        "f_length": n.cast("double"),
        "f_digit": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_sign": share("[^A-Za-z0-9]"),
        "f_hex": F.col("core").rlike("^[0-9a-fA-F]+$").cast("double"),
        "f_lower_digit": share("[a-z](?=[0-9])"),
        "f_digit_lower": share("[0-9](?=[a-z])"),
        "f_upper_digit": share("[A-Z](?=[0-9])"),
        "f_digit_upper": share("[0-9](?=[A-Z])"),
        "f_lower_upper": share("[a-z](?=[A-Z])"),
        "f_upper_lower": share("[A-Z](?=[a-z])"),
        "f_syllable": share("(?i)[b-df-hj-np-tv-z](?=[aeiou])"),
        "f_repeat": share("(.)(?=\\1)"),
        "f_distinct": F.size(F.array_distinct(F.split("core", ""))) / n,
        "f_dictionary": 1 - F.length(F.regexp_replace(F.lower("core"), words, "")) / n,
        "f_known_prefix": F.col("core").rlike("^(AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[abp]-|eyJ|AIza)").cast("double"),
        "f_uuid": F.col("core").rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-").cast("double"),
        "f_address": F.col("word").rlike("(?i)@|://|www\\.|^/|\\.(com|org|net|html?|js|css|png|jpe?g|py|java)\\b").cast("double"),
        "f_path": F.lower(F.coalesce("source", F.lit(""))).rlike(SAMPLE_PATH).cast("double"),
        "f_warning": context.rlike(WARNING).cast("double"),
        "f_harmless": context.rlike(f"\\b({HARMLESS})").cast("double"),
        "f_assigned": (F.col("before1").rlike("[=:]$") | (F.col("name") != "")).cast("double"),
        "f_quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "f_after": F.lower("after1").rlike("^(is|was|by|in|file|and|for)\\b").cast("double"),
    }
    return rows.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()}), list(columns)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n findings with labels (1: a secret), from hashes of their numbers alone, hence the same in every session.

    Half are keys of usual forms after a name that gives them away (a tenth of them after another
    word); half are what looks like them: commits, checksums, identifiers, addresses, placeholders.
    """
    i = F.col("id")
    pick = lambda salt, items: F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(items))) + 1).cast("int"))
    hexes = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 512)
    mixed = F.translate(F.base64(F.unhex(hexes)), "\r\n", "")
    text = DICTIONARY.split()
    two = lambda salt: pick(salt, text)
    camel = F.concat(two(1), F.initcap(two(2)), F.initcap(two(3)), F.initcap(two(4)), F.pmod(i, F.lit(99)).cast("string"))
    snake = F.concat_ws("_", two(1), two(2), two(3), two(4), F.pmod(i, F.lit(2030)).cast("string"))
    filler = ["the", "with", "that", "of", "and", "in", "from", "les", "que", "der", "und", "ention", "thing", "on", "was", ""]
    long_ = (F.pmod(F.xxhash64(i, F.lit(9)), F.lit(3)) * 8 + 24).cast("int")
    secret = F.array(
        F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), F.substr(mixed, F.lit(1), long_), F.substr(F.regexp_replace(mixed, "[+/=]", ""), F.lit(1), F.lit(32)),
        F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))), F.concat(F.lit("ghp_"), F.substr(F.regexp_replace(mixed, "[+/=]", ""), F.lit(1), F.lit(36))),
        F.upper(F.substring(hexes, 1, 40)), F.concat(F.lit("sk_live_"), F.substr(F.regexp_replace(mixed, "[+/=]", ""), F.lit(1), F.lit(24))),
    )
    benign = F.array(
        F.substring(hexes, 1, 40), F.substring(hexes, 1, 64), F.concat_ws("-", *[F.substring(hexes, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), camel, snake,
        F.concat(F.lit("https://"), two(5), F.lit(".example.com/"), snake), F.concat(two(6), F.pmod(i, F.lit(99)).cast("string"), F.lit("@mail"), F.lit("7.example.com")),
        F.concat(F.lit("/usr/lib/"), snake, F.lit(".py")), F.concat(F.lit("your-"), two(7), F.lit("-key-goes-here-123")), F.lit("xxxxxxxxxxxxxxxx0000"), F.concat(F.lit("v1.2.3-beta.4+build"), F.pmod(i, F.lit(9999)).cast("string")),
        F.concat_ws(",", two(1), F.pmod(i, F.lit(999)).cast("string"), two(2), two(3)),
    )
    kind = F.pmod(F.xxhash64(i, F.lit(11)), F.lit(1000))
    label = (F.pmod(i, F.lit(2)) == 0).cast("int")
    core = F.when(label == 1, F.element_at(secret, (F.pmod(kind, F.lit(8)) + 1).cast("int"))).otherwise(F.element_at(benign, (F.pmod(kind, F.lit(12)) + 1).cast("int")))
    odd = F.pmod(F.xxhash64(i, F.lit(12)), F.lit(10)) == 0
    warned = pick(13, ["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "TOKEN", "Secret", "private_key", "credential"])
    calm = pick(14, ["commit", "checksum", "sha256", "md5", "digest", "uuid", "revision", "file", "see", "version", "image", "build", *filler[:6]])
    before2 = F.when((label == 1) & ~odd, warned).when((label == 0) & (F.pmod(kind, F.lit(12)) < 3), calm).otherwise(pick(15, filler))
    before1 = F.when((label == 1) & ~odd, pick(16, ["=", ":", "=", "is"])).otherwise(pick(17, [":", "=", *filler]))
    mark = F.when((label == 1) | odd, pick(18, ['"', '"', "'", ""])).otherwise(F.lit(""))
    tail = pick(19, ["", "", "", "", ",", "###", "!!", ";"])
    return spark.range(n).select(
        F.concat(mark, core, mark, tail).alias("word"), before2.alias("before2"), before1.alias("before1"), pick(20, filler).alias("after1"),
        pick(21, ["src/main", "config", "src0", "src7", "web", "tests/fixtures", "docs/example", "app", "lib", "deploy"]).alias("source"), label.alias("label"),
    )


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """The forest of labelled findings, with the step that assembles its features."""
    rows, names = featured(findings)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED)
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def scan(docs: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """Candidates of docs(doc_id, text, source) with score, the forest's probability of a secret, and is_secret.

    The secret itself does not leave: secret_sha256 and its length stand for it.
    """
    rows, _ = featured(candidates(docs))
    judged = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    return judged.select(
        "doc_id", "word_index", "run_index", F.sha2("core", 256).alias("secret_sha256"), F.length("core").cast("long").alias("length"), "score", (F.col("score") >= threshold).alias("is_secret")
    )


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every candidate secret of the documents with the forest's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return scan(docs, train(labelled_findings(spark)))
