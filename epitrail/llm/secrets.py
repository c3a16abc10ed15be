"""Secret scan: tokens of the texts that may be keys or passwords, judged by a random forest so that false positives fall away.

DataFrame and SQL functions alone find the candidates and their features: length, changes of character class, dictionary
coverage, path shape, and neighbouring words. The dictionary is the corpus's own: its most frequent words; how likely one letter follows
another is learnt from it. What a neighbouring word tells is learnt too, as log odds, on one half of the findings; the forest is trained on
the other half.

Labelled findings are secrets and look-alikes planted in the corpus's documents by templates (:func:`planted_findings`), so a finding is
labelled by what was planted, whatever its features; others can be given. A part of them stands under names that tell nothing, so that the
forest also learns from the values alone. Templates, names and kinds of values can be held out to measure by.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epitrail.llm.common import table

#: A candidate: at least 16 characters that keys consist of, or a value of 8 or more characters, symbols included, beside a word that
#: announces a secret.
LONG = "[A-Za-z0-9+/_=.-]{16,}"
VALUE = r"[A-Za-z0-9!@#$%^&*+/_.~-]{8,}"
SYMBOLS = "[!@#$%^&*~]"
#: What is taken under any name, if it is assigned and has SYMBOLS: 16 characters or more, digits and both cases among them.
STRONG = r"(?=[^\x20\x09-\x0D]*[0-9])(?=[^\x20\x09-\x0D]*[a-z])(?=[^\x20\x09-\x0D]*[A-Z])[A-Za-z0-9!@#$%^&*+/_.~-]{16,}"
SPACE = r"[\x20\x09-\x0D]+"
#: Words that announce a secret. They admit candidates; they are no feature.
ANNOUNCE = "token secret password passwd pwd pass apikey key auth bearer credential credentials"
#: Usual beginnings of keys; they admit candidates without digits or capitals.
PREFIXES = "^(AKIA|ASIA|gh[pousr]_|sk_|pk_|rk_|xox|AIza|eyJ|glpat-|npm_)"
#: Words of the dictionary, the least length of one, and how many neighbouring words have odds of their own.
WORDS, LEAST_LETTERS, NEIGHBOURS = 1_000, 4, 500
#: Planted findings that train the forest.
FINDINGS = 9_000
TREES, DEPTH, SEED = 24, 7, 11
MIN_SCORE = 0.5

#: A few words for tables without text.
PLAIN = "example test sample demo data file path index main module class value name user item list table image static public source content".split()

# What findings are planted as. {n}: a name, {v}: the value.
TEMPLATES = (
    '{n} = "{v}"', "{n}={v}", "{n}: {v}", "{n}: '{v}'", "export {n}={v}", "--{n} {v}", "X-{n}: {v}", "the {n} is {v} and", "use {n} {v} to", '"{n}": "{v}",', "{n} => {v};", "<{n}>{v}</{n}>",
)
SECRET_NAMES = (
    "token secret password passwd api_key auth credential access_key private_key signing_key webhook_secret client_secret db_pass session_key license_key encryption_key master_key bot_token"
).split()
OTHER_NAMES = "commit sha revision checksum digest etag build request_id trace_id file path image asset version uuid order invoice tracking phone isbn".split()
#: What may stand before a name, of either kind.
OWNERS = "app prod db user admin my service stage main web old new".split()
#: Names for measuring: training plants none of them.
UNSEEN_SECRET_NAMES = "passphrase smtp_passwd jwt hmac_salt deploy_key oauth_bearer root_pw vault_seed cookie_signer ssh_material recovery_code pat".split()
UNSEEN_OTHER_NAMES = "fingerprint md5 guid blob parent serial batch ticket slug shard layer thumbnail anchor cursor bucket endpoint".split()


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(dictionary: list[str], odds: dict[str, float]) -> dict[str, Column]:
    """Figures of ``candidate``, ``word``, ``before2``, ``before1``, ``after``."""
    c, word = F.col("candidate"), F.col("word")
    n, low = F.length(c).cast("double"), F.lower("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "#"), "[^A-Za-z#]", "."), "[a-z]", "a"), "[A-Z]", "A")
    sounds = F.regexp_replace(F.regexp_replace(low, "[aeiou]", "V"), "[a-z]", "C")
    runs = lambda x: F.length(F.regexp_replace(x, r"(.)\1+", "$1")).cast("double") - 1
    letters = F.greatest(_count(low, "[a-z]"), F.lit(1.0))
    known = "|".join(sorted((w for w in dictionary if len(w) >= LEAST_LETTERS), key=lambda w: (-len(w), w))) or "(?!)"
    told = F.create_map(*(F.lit(x) for pair in sorted(odds.items()) for x in pair)) if odds else F.create_map(F.lit(""), F.lit(0.0))
    near = F.transform(_neighbours(), lambda w: F.coalesce(F.try_element_at(told, w), F.lit(0.0)))
    return {
        "length": n,
        "class_changes": runs(kinds) / n,
        "sound_changes": runs(sounds) / n,
        "digits": _count(c, "[0-9]") / n,
        "capitals": _count(c, "[A-Z]") / n,
        "hex_only": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / F.least(n, F.lit(64.0)),
        "dictionary": 1 - _count(F.regexp_replace(low, known, ""), "[a-z]") / letters,
        "wordlike": _wordlike(dictionary),
        "slashes": _count(c, "/") / n,
        "dots": _count(c, "[.]") / n,
        "symbols": _count(c, SYMBOLS) / n,
        "separators": _count(c, "[-_]") / n,
        "file_ending": c.rlike(r"\.[a-z]{2,4}[0-9]?$").cast("double"),
        "address": word.rlike(r"://|@[a-z0-9-]+\.").cast("double"),
        "groups": _count(c, "[0-9a-fA-F]{4,12}-"),
        "quoted": word.rlike("[\"'`]").cast("double"),
        "assigned": F.concat_ws(" ", "before1", "word").rlike("[=:]").cast("double"),
        "nearest_most": F.coalesce(F.array_max(near), F.lit(0.0)),
        "nearest_least": F.coalesce(F.array_min(near), F.lit(0.0)),
    }


def _wordlike(dictionary: list[str]) -> Column:
    """Mean log likelihood ratio of a candidate's pairs of adjoining letters: as in the dictionary's words against evenly drawn letters."""
    if not dictionary:
        return F.lit(0.0)
    counts = [1.0] * (26 * 26)
    for w in dictionary:
        for a, b in zip(w, w[1:]):
            counts[(ord(a) - 97) * 26 + ord(b) - 97] += 1
    ratios = F.array(*(F.lit(math.log(n * 26 * 26 / sum(counts))) for n in counts))
    runs = F.filter(F.split(F.lower("candidate"), "[^a-z]+"), lambda r: F.length(r) > 1)
    letter = lambda r, i: F.ascii(F.substring(r, i, F.lit(1))) - 97
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.get(ratios, letter(r, i) * 26 + letter(r, i + 1)))))
    return F.coalesce(F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size(pairs), F.lit(0)), F.lit(0.0))


def _neighbours() -> Column:
    """Lower-case words before a candidate: of the two words before its own, and of its own before the candidate."""
    own = F.expr("substring(word, 1, greatest(locate(candidate, word) - 1, 0))")
    words = F.split(F.lower(F.concat_ws(" ", "before2", "before1", own)), "[^a-z0-9]+")
    return F.filter(words, lambda w: F.length(w) > 1)


def _announces(text: Column) -> Column:
    return text.rlike(r"(?i)(^|[^a-z0-9])(" + "|".join(ANNOUNCE.split()) + r")($|[^a-z0-9])")


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, position, nth, candidate, word, before2, before1, after`` of every candidate.

    Runs of 16 or more key characters need a digit, mixed case, a usual beginning or an announcing word. Other values, of 8 characters or
    more and with any of VALUE's symbols, need an announcing word and ``=`` or ``:`` close before (STRONG ones: no such word); they are taken whole, however long, and
    runs of key characters are then looked for in the rest of the word. ``position``: the word's number in the text, from 0; ``nth``: the candidate's in the word.
    """
    has = docs.select("doc_id", "text").where(F.col("text").rlike("[A-Za-z0-9!@#$%^&*+/_=.~-]{16,}") | F.col("text").rlike("(?i)" + "|".join(ANNOUNCE.split())))
    words = has.select("doc_id", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    at = lambda i, n: F.coalesce(F.get("words", i + n), F.lit(""))
    spoken = lambda i: F.concat_ws(" ", at(i, -2), at(i, -1), at(i, 0))
    place = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(LONG) | (F.get("words", i).rlike(STRONG) & F.get("words", i).rlike(SYMBOLS)) | (F.get("words", i).rlike(VALUE) & _announces(spoken(i))))
    word = words.withColumn("position", F.explode(place))
    part = word.select(
        "doc_id",
        F.col("position").cast("long").alias("position"),
        F.get("words", F.col("position")).alias("word"),
        *(at(F.col("position"), i).alias(n) for n, i in (("before2", -2), ("before1", -1), ("after", 1))),
    )
    announced = _announces(F.concat_ws(" ", "before2", "before1", F.regexp_replace("word", r"[=:>].*$", " "))) & F.concat_ws(" ", "before1", "word").rlike("[=:>]|(^|[^a-z])is ")
    value = F.regexp_extract("word", "(?:^|[=:>\"'`(])(" + VALUE + ")(?=$|[\"'`,;.)<])", 1)
    strong = value.rlike("^" + STRONG) & value.rlike(SYMBOLS) & F.concat_ws(" ", "before1", "word").rlike("[=:>]")
    value = F.when(F.col("announced") | strong, value).otherwise("")
    value = F.when(value.rlike("[0-9!@#$%^&*+/_~-]|[a-z].*[A-Z]|[A-Z].*[a-z]"), value).otherwise("")
    symbols = F.col("value").rlike(SYMBOLS)
    rest = F.when(symbols, F.replace(F.col("word"), F.col("value"), F.lit(" "))).otherwise(F.col("word"))
    long = F.filter(F.regexp_extract_all(rest, F.lit(LONG), F.lit(0)), lambda v: v.rlike("[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]") | v.rlike(PREFIXES) | F.col("announced"))
    whole = (F.col("value") != "") & (symbols | ~F.col("word").rlike(LONG))
    found = F.when(whole, F.concat(F.array("value"), long)).otherwise(long)
    return part.withColumn("announced", announced).withColumn("value", value).select("doc_id", "position", "word", "before2", "before1", "after", F.posexplode(found).alias("nth", "candidate"))


def corpus_words(docs: DataFrame, n: int = WORDS) -> list[str]:
    """The ``n`` words of letters alone, of :data:`LEAST_LETTERS` or more, that stand in the most documents, over all documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\p{{L}}\p{{N}}_])[a-z]{{{LEAST_LETTERS},}}(?![\p{{L}}\p{{N}}_])"), F.lit(0)))
    counts = docs.where(F.col("text").isNotNull()).select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r.w for r in counts.where("n > 1").orderBy(F.desc("n"), "w").limit(n).collect()]


def planted_findings(spark: SparkSession, docs: DataFrame | None = None, dictionary: list[str] = (), n: int = FINDINGS, seed: str = "", unseen: bool = False) -> DataFrame:
    """``n`` labelled texts: ``doc_id, text, planted, secret, template``; a secret or a look-alike, planted by a template.

    The words around are those of documents, at a random place each; without documents there are none. A third are keys and passwords
    under names of secrets; the rest are what looks like keys under other names, or names, paths and words under any. One in five stands
    under two words of the dictionary that tell nothing. ``unseen``: names, and kinds of values, that training never meets.
    """
    ids = spark.range(0, n, 1, 4)
    salt = lambda x: F.lit(f"{seed}{x}")
    h = lambda x: F.sha2(F.concat_ws("-", salt(x), F.col("id").cast("string")), 256)
    any_of = lambda x, k: F.pmod(F.xxhash64(salt(x), "id"), F.lit(k)).cast("int")
    pick = lambda x, words: F.get(F.array(*map(F.lit, words)), any_of(x, len(words)))
    known = [w for w in dictionary if len(w) >= LEAST_LETTERS][:200] or PLAIN
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(h("b"), h("c")))), "[+/=\\s]", "")
    length = 20 + any_of("n", 28)
    any_hex = F.substring(h("x"), F.lit(1), F.get(F.array(F.lit(32), F.lit(40), F.lit(64)), any_of("hex", 3)))
    name = F.concat_ws("_", *(pick(f"w{i}", known) for i in range(3)))
    path = F.concat(F.concat_ws("/", *(pick(f"p{i}", known) for i in range(3))), F.lit("/"), F.substring(h("p"), 1, 3), pick("end", [".html", ".png", ".py", ""]))
    camel = F.regexp_replace(F.initcap(F.concat_ws(" ", *(pick(f"m{i}", known) for i in range(3)))), " ", "")
    uuid = F.regexp_replace(F.substring(h("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    number = F.substring(F.concat(*(F.conv(F.substring(h(f"d{i}"), 1, 8), 16, 10) for i in range(2))), 1, 16)
    password = F.concat(F.substring(b64, 3, 5), pick("sym", ["!", "#", "_", "-", "7", "$"]), F.substring(b64, F.lit(11), 3 + any_of("pl", 5)))
    prefixed = F.concat(pick("g", ["ghp_", "sk_live_", "xoxb-", "glpat-", "AKIA"]), F.substring(b64, 1, 24))
    dotted = F.concat(F.lit("eyJ"), F.substring(b64, 1, 20), F.lit("."), F.substring(b64, 21, 24), F.lit("."), F.substring(b64, 45, 20))
    mixed = F.substring(b64, F.lit(1), length)
    phrase = F.concat_ws("", pick("f0", known), pick("s0", list("!@#$%&*")), F.initcap(pick("f1", known)), pick("s1", list("!@#$%&*")), F.substring(h("f"), 1, 4))
    if unseen:
        base32 = F.translate(F.upper(mixed), "0189", "WXYZ")
        joined = F.concat(F.substring(b64, 1, 11), F.lit("-"), F.substring(b64, 12, 9), F.lit("_"), F.substring(b64, 21, 14))
        clouded = F.concat(pick("g", ["SG.", "hf_", "shpat_", "dop_v1_"]), F.substring(b64, 1, 30))
        secret = [base32, joined, clouded, F.concat(password, phrase), mixed, F.concat(F.substring(b64, 1, 8), F.lit("/"), F.substring(b64, 9, 16), F.lit("="))]
        stamp = F.concat(F.lit("20"), F.substring(number, 1, 2), F.lit("-0"), F.substring(number, 3, 1), F.lit("-1"), F.substring(number, 4, 1), F.lit("T"), F.substring(number, 5, 6), F.lit("Z"))
        alike = [F.substring(h("x"), 1, 48), F.upper(any_hex), F.upper(uuid), F.concat(F.lit("v"), number), stamp, F.concat(path, F.lit(".jpeg"))]
        slug = F.concat_ws("-", *(pick(f"w{i}", known) for i in range(4)), F.substring(number, 1, 3))
        plain = [slug, F.concat(camel, F.lit("Test2")), F.concat(path, F.lit("/"), name), F.upper(name)]
    else:
        secret = [mixed, mixed, password, prefixed, dotted, any_hex, phrase, F.translate(mixed, "lIO0", "xyz7")]
        alike = [any_hex, uuid, any_hex, number, path, F.upper(any_hex), mixed, F.substring(h("x"), F.lit(1), length)]
        plain = [name, path, camel, F.concat(camel, F.lit("1")), F.concat(name, F.lit("-"), F.substring(number, 1, 4)), F.upper(name)]
    of = lambda x, values: F.get(F.array(*values), any_of(x, len(values)))
    owned = lambda name: F.when(any_of("owned", 2) == 0, F.concat_ws("_", pick("owner", OWNERS), name)).otherwise(name)
    kind = any_of("kind", 3)
    drawn = ids.select(
        "id",
        any_of("t", len(TEMPLATES)).alias("template"),
        (kind == 0).cast("double").alias("secret"),
        F.when(kind == 0, of("vs", secret)).when(kind == 1, of("va", alike)).otherwise(of("vp", plain)).alias("planted"),
        F.when((any_of("tells", 5) == 0) & F.lit(not unseen), F.concat_ws("_", pick("n0", known), pick("n1", known)))
        .when((kind == 0) | ((kind == 2) & (any_of("which", 2) == 0)), owned(pick("sn", UNSEEN_SECRET_NAMES if unseen else SECRET_NAMES)))
        .otherwise(owned(pick("on", UNSEEN_OTHER_NAMES if unseen else OTHER_NAMES)))
        .alias("name"),
        any_of("case", 4).alias("case"),
    )
    form = F.get(F.array(*map(F.lit, TEMPLATES)), F.col("template"))
    called = F.when(F.col("case") == 0, F.upper("name")).otherwise(F.col("name"))
    planted = drawn.withColumn("made", F.replace(F.replace(form, F.lit("{n}"), called), F.lit("{v}"), F.col("planted")))
    if docs is None:
        return planted.select(F.col("id").alias("doc_id"), F.col("made").alias("text"), "planted", "secret", "template")
    # the ``n`` texts with the smallest hashes, each once; hashes alone are sorted
    hashed = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    some = hashed.where(F.col("h") <= F.lit(last).cast("long")).withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    place = F.pmod(F.col("h"), F.size("words") + 1).cast("int")
    left = F.array_join(F.slice("words", F.greatest(place - 3, F.lit(0)) + 1, F.least(place, F.lit(4))), " ")
    right = F.array_join(F.slice("words", place + 1, F.lit(3)), " ")
    around = some.select("h", left.alias("left"), right.alias("right")).groupBy("h").agg(F.min("left").alias("left"), F.min("right").alias("right"))
    around = around.withColumn("id", (F.row_number().over(Window.orderBy("h")) - 1).cast("long"))  # at most ``n`` rows
    joined = planted.join(around, "id", "left")
    text = F.concat_ws(" ", "left", "made", "right")
    return joined.select(F.col("id").alias("doc_id"), text.alias("text"), "planted", "secret", "template")


@dataclass
class Scanner:
    """A forest, and the words that its features read."""

    forest: PipelineModel
    dictionary: list[str]
    odds: dict[str, float]


def labelled(findings: DataFrame) -> DataFrame:
    """The candidates of planted texts with ``secret``: those that are part of what was planted."""
    found = candidates(findings.select("doc_id", "text"))
    known = findings.select("doc_id", "planted", "secret", "template")
    return found.join(known, "doc_id").where(F.col("planted").contains(F.col("candidate")) | F.col("candidate").contains(F.col("planted")))


def train(findings: DataFrame, dictionary: list[str] = ()) -> Scanner:
    """A scanner from planted or other labelled texts: ``doc_id, text, planted, secret, template``.

    Odds of neighbouring words come from one half of the texts, the forest from the other. At most :data:`NEIGHBOURS` words have odds.
    """
    rows = labelled(findings)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    met = rows.where(half == 0).select("secret", F.explode(F.array_distinct(_neighbours())).alias("w")).groupBy("w").agg(F.sum("secret").alias("yes"), F.sum(1 - F.col("secret")).alias("no"))
    log = F.ln((F.col("yes") + 0.5) / (F.col("no") + 0.5))
    strongest = met.where("yes + no >= 5").select("w", log.alias("o")).orderBy(F.desc(F.abs("o")), "w").limit(NEIGHBOURS).collect()
    odds = {r.w: r.o for r in strongest}
    columns = features(list(dictionary), odds)
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="features"),
        RandomForestClassifier(labelCol="secret", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt"),
    ]
    return Scanner(Pipeline(stages=stages).fit(rows.where(half == 1).withColumns(columns)), list(dictionary), odds)


def scan(docs: DataFrame, scanner: Scanner, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, position, nth, n_chars, masked, sha256, score, is_secret``, a row a candidate of any row of ``docs``.

    ``masked`` shows four characters; ``sha256`` identifies equal secrets. Null, empty and plain texts give no rows, and so does an empty
    table; repeated rows give repeated findings; a null doc_id stays null. Texts of any length are read whole. Other columns take no part.
    """
    scored = scanner.forest.transform(candidates(docs).withColumns(features(scanner.dictionary, scanner.odds)))
    score = vector_to_array("probability")[1]
    return scored.select(
        "doc_id", "position", "nth", F.length("candidate").alias("n_chars"),
        F.concat(F.substring("candidate", 1, 4), F.lit("...")).alias("masked"),
        F.sha2("candidate", 256).alias("sha256"), score.alias("score"), (score >= min_score).alias("is_secret"),
    )


def trained(docs: DataFrame) -> Scanner:
    """A scanner with the corpus's dictionary, trained on findings planted in its documents."""
    words = corpus_words(docs)
    return train(planted_findings(docs.sparkSession, docs, words), words)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, trained(docs))
