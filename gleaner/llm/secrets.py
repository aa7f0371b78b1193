"""Secret scan with a random forest against false positives (DataFrame functions only).

Candidates are all runs of 16 or more key characters among which is a digit, runs of 8 or more
after a word that announces a secret or in a word that assigns to such a name, and private-key blocks.
Runs end at '=' but for base64 padding; a quoted value with '=' inside is a candidate as a whole as well.
The name that a value is assigned to is no part of it. Each gets a row of features: length, kinds
of characters and transitions between them, distinct characters, bigrams of natural language, coverage by
dictionary words, known prefixes, the assigned name, the path or source, and the words before and after. A random forest,
trained here on labelled findings, gives the probability that a candidate is a secret. Labelled findings
are a table (text, path, label) with one candidate in each text; ``labelled_findings`` makes the
standard set from templates with a seed, and ``train`` takes any other.

Values leave this module only as SHA-256 and a masked form of fixed length, which shows the first three characters of
values of 20 or more and nothing of shorter ones.

Defined results: null and empty texts have no findings; a null path is empty; repeated rows repeat their
findings; a very long value is a candidate like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import random

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm._common import let, text_of

ANNOUNCE = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth)"
KEY, QUOTES = "A-Za-z0-9+/_~.-", "\"'`"
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk[-_]|pk[-_]|rk_|AIza|eyJ|SG\.|npm_|hf_|dop_v1_)"
HARMLESS = r"(?i)(commit|checksum|sha1|sha256|md5|digest|revision|uuid|version|build|hash|etag|example|sample|order|invoice|phone|isbn|card)"
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your[_-]|xxxx|1234|abcd|0000|test|todo|redacted)"
QUIET_PATH = r"(?i)(test|spec|example|sample|fixture|mock|doc|readme|lock|vendor|node_modules|dist)"
BIGRAMS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
WORDS = "able access account action admin after application array async await base before branch build cache change check class client code commit common config connect content context control count create data database date default delete description device document domain down download email enable encode error event example false field file find first float folder form format from function general get group handle header hello hidden home host http https icon image import index info input insert install integer interface internal item javascript json label language last layout length library light line link list load local login manager master match message method model module name network node normal number object open option order output package page param parent parse password path pattern phone plugin point port post power preview private process product profile project property public query random read record redirect region release remote remove rename render report request reset resource response result return revision root route sample save scale schema screen script search section select send server service session setting simple size source space stack start state static status storage store stream string style submit support system table target task template test text theme time title token tool total track transaction transform true type undefined union update upload user util valid value variable vector version view virtual warning web widget width window with word work write year zone".split()

FEATURES = ["length", "upper", "lower", "digit", "other", "shifts", "letter_digit", "distinct", "longest_run", "vowels", "bigrams", "covered", "hex", "uuid", "prefix", "padded", "placeholder", "announced", "assigned", "quoted", "harmless", "quiet_path", "words_near"]


_CLOSED = rf"(?=[{QUOTES}\\]*(?:$|[,;)\]}}>&|]))"
_RUN = rf"(?:[{KEY}]{{7,}}+={{1,2}}{_CLOSED}|[{KEY}]{{6}}=={_CLOSED}|[{KEY}]{{8,}}+)"
#: Groups 1 and 2: the name that a run is assigned to, if any, and the run. A padded value is no name.
RUN = rf"(?:([{KEY}]++)(?!={{1,2}}{_CLOSED})[^{KEY}=:]*+[=:][^{KEY}]*+(?={_RUN}(?![{QUOTES}\\]*[=:])))?[{QUOTES}]?({_RUN})[{QUOTES}]?"
#: The same for a whole quoted value with '=' inside.
QUOTED = rf"(?:([{KEY}]++)[^{KEY}=:]*+[=:][^{KEY}=]*+)?(?<=[{QUOTES}])([{KEY}=]{{8,}}+)[{QUOTES}]"
_INNER = rf"[{KEY}]=+[{KEY}]"
_NAME = ANNOUNCE.replace("(?i)", r"(?i)^[\w.-]*") + r"[\w.-]*=*$"
_ASSIGNS = ANNOUNCE + rf"[\w.-]*[^{KEY}=:]*[=:]"


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` (with text and path) by candidate: word_at (-1 for key blocks), value, raw (the value with its
    assigned name and quotes), name, and what the words near by say: near_announced, near_assigned,
    near_harmless, near_words."""
    begin = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    block = begin + r"[\s\S]*?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    likely = rows.where(F.col("text").rlike(rf"[{KEY}=]{{16}}|" + block) | F.col("text").rlike(ANNOUNCE))
    likely = likely.withColumn("_words", F.split("text", r"[\x20\x09-\x0D]+"))

    def near(i: Column, start: int, n: int) -> Column:
        from_ = F.greatest(i + start, F.lit(0))
        return F.array_join(F.slice("_words", from_ + 1, F.when(i + start < 0, F.lit(n) + i + start).otherwise(n).cast("int")), " ")

    def runs(w: Column, pattern: str) -> Column:
        """raw, name, value of every match."""
        raw, name, value = (F.regexp_extract_all(w, F.lit(pattern), F.lit(k)) for k in range(3))
        return F.arrays_zip(raw.alias("raw"), name.alias("name"), value.alias("value"))

    def of_word(w: Column) -> Column:
        """All runs of a word, those that are names of others too, and quoted values with '=' inside."""
        names = lambda found: F.transform(F.filter(found, lambda c: F.length(c["name"]) >= 8), lambda c: F.struct(c["name"].alias("raw"), F.lit("").alias("name"), c["name"].alias("value")))
        plain = let(runs(w, RUN), lambda found: F.concat(found, names(found)))
        whole = F.filter(runs(w, QUOTED), lambda c: c["value"].rlike(_INNER))
        return F.when(w.rlike(rf"[{QUOTES}][{KEY}=]*{_INNER}"), F.concat(plain, whole)).otherwise(plain)

    def wanted(c: Column, w: Column, said: Column, assigns: Column) -> Column:
        long = (F.length(c["value"]) >= 16) & c["value"].rlike("[0-9]")
        bare = F.regexp_replace(c["value"], "=+$", "")
        followed = F.lit(False)
        for sign in ("=", ":", '":', "':", '"=', "'=", '\\":'):
            followed = followed | F.contains(w, F.concat(bare, F.lit(sign)))
        is_name = (c["name"] == "") & c["value"].rlike(_NAME) & followed
        return long | (said | assigns | c["name"].rlike(ANNOUNCE)) & ~is_name

    def of(s: Column) -> Column:
        """The candidates of one word; the words near it are looked at once."""
        kept = lambda near_: F.filter(of_word(s["w"]), lambda c: wanted(c, s["w"], near_["said"], near_["assigns"]))
        before, after = near(s["i"], -3, 3), near(s["i"], 1, 2)
        seen = F.struct(
            before.rlike(ANNOUNCE).alias("said"),
            s["w"].rlike(_ASSIGNS).alias("assigns"),
            before.rlike("[=:]$").alias("assigned"),
            (before.rlike(HARMLESS) | after.rlike(HARMLESS)).alias("harmless"),
            F.regexp_count(F.concat_ws(" ", before, after), F.lit(r"\b[a-zA-Z]{3,}\b")).alias("words"),
        )
        row = lambda c, n: F.struct(s["i"].alias("word_at"), c["value"].alias("value"), c["raw"].alias("raw"), c["name"].alias("name"), n["said"].alias("near_announced"), n["assigned"].alias("near_assigned"), n["harmless"].alias("near_harmless"), n["words"].alias("near_words"))
        return let(seen, lambda n: F.transform(kept(n), lambda c: row(c, n)))

    numbered = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: s["w"].rlike(rf"[{KEY}=]{{8}}"))
    found = F.flatten(F.transform(numbered, of))
    no = F.lit(False)
    keys = F.transform(
        # A block without end before this one is no part of it.
        F.transform(F.regexp_extract_all("text", F.lit(block), F.lit(0)), lambda v: F.regexp_replace(v, rf"\A[\s\S]+(?={begin})", "")),
        lambda v: F.struct(F.lit(-1).alias("word_at"), v.alias("value"), v.alias("raw"), F.lit("").alias("name"), F.lit(True).alias("near_announced"), no.alias("near_assigned"), no.alias("near_harmless"), F.lit(1).alias("near_words")),
    )
    return likely.select("*", F.explode(F.concat(found, keys)).alias("_c")).select("*", "_c.*").drop("_c", "_words", "text")


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.greatest(F.length("value"), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES, all doubles."""
    low = F.lower("value")
    n = F.greatest(F.length("value"), F.lit(1))
    made = {
        "length": F.log1p(F.length("value")),
        "upper": _share("[A-Z]"),
        "lower": _share("[a-z]"),
        "digit": _share("[0-9]"),
        "other": _share("[^A-Za-z0-9]"),
        "shifts": _share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "letter_digit": _share("(?<=[A-Za-z])(?=[0-9])"),
        "distinct": F.size(F.array_distinct(F.split(F.col("value"), ""))) / n,
        "longest_run": F.log1p(F.coalesce(F.array_max(F.transform(F.regexp_extract_all("value", F.lit("[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))) / F.log1p(n),
        "vowels": F.regexp_count(low, F.lit("[aeiou]")) / F.greatest(F.regexp_count(low, F.lit("[a-z]")), F.lit(1)),
        "bigrams": F.regexp_count(low, F.lit("(?=" + "|".join(BIGRAMS) + ")")) / n,
        "covered": 1 - F.length(F.regexp_replace(low, "(" + "|".join(sorted(WORDS, key=len, reverse=True)) + ")", "")) / n,
        "hex": F.col("value").rlike(r"^([0-9a-f]+|[0-9A-F]+)$"),
        "uuid": low.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
        "prefix": F.col("value").rlike(PREFIX) | F.col("value").startswith("-----BEGIN"),
        "padded": F.col("value").rlike("=+$"),
        "placeholder": F.col("value").rlike(PLACEHOLDER),
        "announced": F.col("near_announced") | F.col("raw").rlike(ANNOUNCE),
        "assigned": F.col("near_assigned") | (F.col("name") != ""),
        "quoted": F.col("raw").rlike("[\"'`]"),
        "harmless": F.col("near_harmless") | F.col("raw").rlike(HARMLESS),
        "quiet_path": F.coalesce(F.col("path"), F.lit("")).rlike(QUIET_PATH),
        "words_near": F.col("near_words"),
    }
    return found.select("*", *[F.coalesce(made[c].cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


def labelled_findings(n: int = 1_500, seed: int = 23) -> list[tuple[str, str, int]]:
    """(text, path, label) from templates: keys and passwords in assignments and headers, against digests,
    ids, placeholders, long identifiers, numbers and words."""
    r = random.Random(seed)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    letters = "abcdefghijklmnopqrstuvwxyz"
    mixed = lambda k: "".join(r.choice(letters + letters.upper() + "0123456789") for _ in range(k))
    upper = lambda k: "".join(r.choice(letters.upper() + "0123456789") for _ in range(k))
    prose = lambda k: " ".join("".join(r.choice(BIGRAMS) for _ in range(r.randint(1, 4))) for _ in range(k))
    names = ["token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "DB_PASSWORD", "credential"]
    true = [
        lambda: f'{r.choice(names)} = "{hexes(r.choice([32, 40, 64]))}"',
        lambda: f'{r.choice(names)}: {mixed(r.randint(20, 48))}',
        lambda: f'{r.choice(names)}="{mixed(r.randint(16, 40))}"',
        lambda: f"AKIA{upper(16)}",
        lambda: f"aws_access_key_id = AKIA{upper(16)}",
        lambda: f"ghp_{mixed(36)}",
        lambda: f"sk_live_{mixed(24)}",
        lambda: f"xoxb-{r.randint(10**10, 10**11)}-{mixed(24)}",
        lambda: f"AIza{mixed(35)}",
        lambda: f"Authorization: Bearer {mixed(r.randint(30, 60))}",
        lambda: f"{r.choice(names)} = '{base64.b64encode(r.randbytes(r.randint(18, 40))).decode()}'",
        lambda: f"{r.choice(names)} {mixed(r.randint(20, 40))}",
    ]
    false = [
        lambda: f"commit {hexes(40)}",
        lambda: f"sha256: {hexes(64)}",
        lambda: f"md5 checksum {hexes(32)}",
        lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
        lambda: f'{r.choice(names)} = "your_{r.choice(names)}_here_1234"',
        lambda: f'{r.choice(names)} = "xxxxxxxxxxxx1234xxxxxxxx"',
        lambda: f"{r.choice(WORDS)}{r.choice(WORDS).title()}{r.choice(WORDS).title()}{r.randint(1, 99)}",
        lambda: f"{r.choice(WORDS)}_{r.choice(WORDS)}_{r.choice(WORDS)}_{r.randint(1, 9)}",
        lambda: f"{r.choice(WORDS)}/{r.choice(WORDS)}/{r.choice(WORDS)}-{r.randint(1, 9)}.{r.randint(0, 9)}.js",
        lambda: str(r.randint(10**15, 10**16)),
        lambda: f"card {r.randint(10**15, 10**16)}",
        lambda: "".join(r.choice(BIGRAMS) for _ in range(r.randint(8, 12))) + str(r.randint(0, 9)),
        lambda: f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}.{r.randint(10, 59)}.{r.randint(10, 59)}Z",
        lambda: f"the {r.choice(names[:3])} {''.join(r.choice(BIGRAMS) for _ in range(r.randint(4, 8)))}",
        lambda: f"{''.join(r.choice(letters) for _ in range(6))}.{r.randint(10, 99)}@{r.choice(WORDS)}.{r.choice(WORDS)}.com",
    ]
    quiet, loud = ["tests/a.py", "docs/readme.md", "package-lock.json"], ["src/main.py", "config/prod.env", "", "app.js"]
    out = []
    for i in range(n):
        label = i % 2
        made = r.choice(true if label else false)()
        path = r.choice(loud if r.random() < (0.8 if label else 0.5) else quiet)
        out.append((f"{prose(r.randint(0, 5))} {made} {prose(r.randint(0, 4))}".strip(), path, label))
    return out


def train(spark: SparkSession, labelled: DataFrame | None = None, *, trees: int = 60, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    """A forest from labelled findings (text, path, label)."""
    if labelled is None:
        labelled = spark.createDataFrame(labelled_findings(), "text string, path string, label int")
    rows = with_features(candidates(labelled.withColumn("label", F.col("label").cast("double"))))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label"))


def scan(docs: DataFrame, forest: RandomForestClassificationModel, *, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, word_at, length, masked, value_sha256, probability, is_secret."""
    where = docs[path].cast("string") if path and path in docs.columns else F.lit("")
    rows = docs.select("doc_id", text_of(docs).alias("text"), where.alias("path"))
    found = with_features(candidates(rows))
    model = PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features"), forest])
    probability = vector_to_array("probability")[1]
    out = model.transform(found).withColumn("p", probability)
    masked = F.rpad(F.when(F.length("value") >= 20, F.substring("value", 1, 3)).otherwise(""), 12, "*")
    return out.select(
        "doc_id",
        F.col("word_at").cast("long").alias("word_at"),
        F.length("value").cast("long").alias("length"),
        masked.alias("masked"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        F.round("p", 6).alias("probability"),
        (F.col("p") >= threshold).alias("is_secret"),
    )


def digest_of(value: str) -> str:
    """How a finding's value is named in results."""
    return hashlib.sha256(value.encode()).hexdigest()
