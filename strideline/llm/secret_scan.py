"""Secret scans: candidates by shape, kept or dropped by a random forest, in DataFrame functions only.

A text is cut into pieces at white space, quotes, brackets and , ; & ? |, so a line of JSON or the query of an address
gives each of its values. A candidate is a piece of 16 or more token characters with a digit, a piece that follows a
word such as "password" and an assignment sign, or a block between BEGIN and END lines. Its features are its length,
shares and transitions of character classes, the part of it that common words cover, whether it looks like a path,
address, number or identifier, what the three pieces before it say, and what the document's path says. Spark trains a
random forest on ``labelled_findings``, a table of labelled findings made by rule; its trees become one SQL expression,
so scanning is a narrow pass without a shuffle: every candidate of a document, with its score, is an array in the
document's row. What has no digit and no such word before it is no candidate: of random strings of 32 letters and
digits that is 1 in 300.

Null and empty texts have no candidates. Repeated rows are scanned alike. Extra columns stay in ``redact`` and are not
returned by ``findings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Prefixes of public credential formats, and words that speak for or against a secret.
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk- sk_live_ rk_live_ xoxb- xoxp- xoxa- AIza ya29. eyJ npm_ pypi- SG. dop_v1_".split()
FOR = "password passwd passphrase pass pwd secret token apikey api_key api-key access_key private_key key credential credentials auth authorization bearer login".split()
AGAINST = "sha sha1 sha256 commit md5 checksum digest hash uuid guid version build release url link isbn doi order invoice phone tel card account tracking example sample revision etag".split()
COMMON = "about account address after also and any are back been build button can chapter class click code config content count data date default design document down each error event example file first for form from get give have here home image index info input item key line link list load local main make message method model more name new node not number object only open order other out over page part path people place product project public report request result return right same screen section see service session set should some state string system table test text that the their them then there they this time title tree type update use user value version very view want was web week well what when which will window with word work world would year you".split()

TOKEN = r"[A-Za-z0-9_+/.\-]"
_FOR = "|".join(FOR).replace("-", "\\-")
#: What a text must hold for any candidate.
KEY_ID = r"(AKIA|ASIA)[A-Z0-9]{16}"
ANY = rf"{KEY_ID}|(?=[A-Za-z_+/.\-]*[0-9]){TOKEN}{{16,}}|(?i:{_FOR})[a-z_]*[\"']?\s*[=:]|-----BEGIN |://[^\s/:@]+:[^\s/@]+@"
BLOCK = r"-----BEGIN [A-Z ]+-----[\s\S]*?(-----END [A-Z ]+-----|$)"
TREES, DEPTH, SEED, THRESHOLD = 15, 7, 1, 0.5
FINDING = "[SECRET]"
#: What a finding can't have beside it: the characters that are never trimmed from its ends.
BEFORE, AFTER = "(?<![A-Za-z0-9+/_-])", "(?![A-Za-z0-9+/_=-])"

FEATURES = "length digits upper lower hex transitions distinct covered prefix said_for assigned said_against slashes dots at_sign numeric uuid test_path private".split()


def _sql(pattern: str) -> str:
    return "r\"" + pattern.replace('"', "\\x22") + "\""


#: The text's pieces outside blocks. A password in an address is set apart as one.
_PIECES = f"filter(split(regexp_replace(if(contains(text, '-----BEGIN '), regexp_replace(text, {_sql(BLOCK)}, ' '), text), {_sql('://([^\\s/:@]+):([^\\s/@]+)@')}, '://$1 password: $2 @'), {_sql('[\\x20\\x09-\\x0D\\x22\\x27`{}()<>,;&?|\\[\\]]+')}), x -> x <> '')"
#: Blocks, and pieces with a candidate's shape or after a word for a secret and an assignment sign.
_CANDIDATES = f"""
concat(
  if(contains(text, '-----BEGIN '), transform(regexp_extract_all(text, {_sql(BLOCK)}, 0), x -> named_struct('word', x, 'position', -1, 'near', '')), cast(array() as array<struct<word: string, position: int, near: string>>)),
  filter(transform(words, (w, i) -> named_struct(
    'word', w, 'position', i,
    'near', lower(concat_ws(' ', get(words, i - 3), get(words, i - 2), get(words, i - 1))))),
  c -> (length(c.word) >= 20 and c.word rlike {_sql(KEY_ID)})
    or (length(c.word) >= 16 and c.word rlike {_sql(rf'(?=[A-Za-z_+/.-]*[0-9]){TOKEN}{{16,}}')})
    or (length(c.word) >= 6 and c.near rlike {_sql(rf'({_FOR})[a-z_]*\s*[=:]+>?$')})
    or c.word rlike {_sql(rf'(?i)({_FOR})[a-z_]*[=:]+[^=:]{{6,}}')}))
"""

#: The part after an assignment inside the word, without quotes and punctuation at its ends.
_VALUE = f"regexp_replace(regexp_replace(c.word, {_sql(r'^.*?[A-Za-z_]{3,}[\x22\x27]?[=:]+(?=[^=:]{6,})')}, ''), {_sql(r'^[^A-Za-z0-9+/_-]+|[^A-Za-z0-9+/_=-]+$')}, '')"


def _share(pattern: str) -> str:
    return f"regexp_count(v, {_sql(pattern)}) / length(v)"


_COMMON = "|".join(sorted(COMMON, key=lambda w: (-len(w), w)))
_FEATURE_SQL = f"""
named_struct(
  'length', least(200, length(v)) * 1D,
  'digits', {_share('[0-9]')}, 'upper', {_share('[A-Z]')}, 'lower', {_share('[a-z]')},
  'hex', if(v rlike {_sql('^([0-9a-f]+|[0-9A-F]+)$')}, 1D, 0D),
  'transitions', {_share('[a-z](?=[^a-z])|[A-Z](?=[^A-Za-z])|[0-9](?=[^0-9])')},
  'distinct', size(array_distinct(split(v, ''))) / length(v),
  'covered', (length(v) - length(regexp_replace(lower(v), {_sql(_COMMON)}, ''))) / length(v),
  'prefix', if(v rlike {_sql('^(' + '|'.join(p.replace('.', '[.]') for p in PREFIXES) + ')')}, 1D, 0D),
  'said_for', if(concat(c.near, ' ', if(length(c.word) > length(v), lower(substring(c.word, 1, length(c.word) - length(v))), '')) rlike {_sql(rf'(?<![a-z])({_FOR})')}, 1D, 0D),
  'assigned', if(c.near rlike '[=:]+>?$' or c.word rlike {_sql(r'^[A-Za-z_]+[\x22\x27]?[=:]')}, 1D, 0D),
  'said_against', if(c.near rlike {_sql('(?<![a-z])(' + '|'.join(AGAINST) + ')(?![a-z])')}, 1D, 0D),
  'slashes', {_share('/')}, 'dots', {_share('[.]')},
  'at_sign', if(c.word rlike '@|://', 1D, 0D),
  'numeric', if(v rlike {_sql('^[0-9.+/-]+$')}, 1D, 0D),
  'uuid', if(v rlike {_sql('^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')}, 1D, 0D),
  'private', if(startswith(v, '-----BEGIN') and v rlike '^-----BEGIN [A-Z ]*PRIVATE', 1D, 0D),
  'test_path', if(lower(path) rlike {_sql('(^|[^a-z])(test|tests|example|examples|fixture|fixtures|mock|sample)([^a-z]|$)')}, 1D, 0D))
"""


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _per_candidate(inner: str) -> str:
    """SQL of an array with ``inner`` (of c, v and f) for each candidate of ``text`` whose value is not empty."""
    each = _let("v", _VALUE, f"if(length(v) < 6, null, {_let('f', _FEATURE_SQL, inner)})")
    found = _let("words", _PIECES, f"filter(transform({_CANDIDATES}, c -> {each}), x -> x is not null)")
    return f"if(text rlike {_sql(ANY)}, {found}, filter(array({each_null(inner)}), x -> false))"


def each_null(inner: str) -> str:
    """One value of the same type as ``inner``, over empty inputs."""
    c = "named_struct('word', '', 'position', 0, 'near', '')"
    return _let("c", c, _let("v", "'none'", _let("f", _FEATURE_SQL, inner)))


def labelled_findings(spark: SparkSession, rows: int = 3480) -> DataFrame:
    """Labelled findings by rule: text, path and y (1: a secret). Every kind occurs with several neighbours."""
    h, b = "sha2(concat('s', id), 512)", "translate(base64(unhex(sha2(concat('b', id), 512))), '+/=', 'xyz')"
    up = f"upper({b})"
    cue = "element_at(array('token =', 'password:', 'api_key =', 'secret:', 'auth_token =', 'access_key:', 'TOKEN =', 'credential ='), cast(1 + (id div 29) % 8 as int))"
    lead = "element_at(array('the value here', 'and so on', 'of these', 'it was', 'lorem ipsum dolor', 'see also'), cast(1 + (id div 7) % 6 as int))"
    note = "element_at(array('commit', 'md5', 'checksum:', 'sha1 =', 'revision', 'digest:', 'build', 'hash ='), cast(1 + (id div 29) % 8 as int))"
    line = f"substring({b}, 1, 40)"
    kinds = [
        (1, f"concat({cue}, ' \"', substring({h}, 1, cast(32 + 8 * ((id div 29) % 3) as int)), '\"')"),
        (1, f"concat({cue}, ' \"', upper(substring({h}, 1, 40)), '\"!!')"),
        (1, f"concat({cue}, ' ', substring({b}, 1, cast(20 + (id div 29) % 40 as int)))"),
        (1, f"concat('AKIA', substring({up}, 1, 16))"),
        (1, f"concat('ghp_', substring({b}, 1, 36))"),
        (1, f"concat('sk-', substring({b}, 1, 40), ',')"),
        (1, f"concat('xoxb-', conv(substring({h}, 1, 9), 16, 10), '-', substring({b}, 1, 24))"),
        (1, f"concat('eyJ', substring({b}, 1, 30), '.', substring({b}, 5, 40), '.', substring({b}, 9, 30))"),
        (1, f"concat('password=', substring({b}, 1, cast(8 + (id div 29) % 9 as int)))"),
        (1, f"concat({cue}, ' ', substring({b}, 3, cast(8 + (id div 29) % 6 as int)), '#', substring({h}, 1, 2))"),
        (0, f"concat({note}, ' ', substring({h}, 1, 40))"),
        (0, f"concat({note}, ' ', substring({h}, 1, cast(32 + 32 * ((id div 29) % 2) as int)))"),
        (0, f"concat(substring({h}, 1, 8), '-', substring({h}, 9, 4), '-4', substring({h}, 13, 3), '-a', substring({h}, 17, 3), '-', substring({h}, 21, 12))"),
        (0, f"concat('https://www.example.com/', substring({h}, 1, 6), '/page', id, '/index.html')"),
        (0, "concat('src/main/module', id, '/report_file_', id % 97, '.txt')"),
        (0, "concat('user.name', id, '@mail', id % 9, '.example.com')"),
        (0, f"lpad(conv(substring({h}, 1, 13), 16, 10), 16, '4')"),
        (0, "concat(element_at(array('documentversion', 'userprofilepage', 'chaptersection', 'thequickupdate', 'productlistview'), cast(1 + (id div 29) % 5 as int)), id)"),
        (0, "concat('20', 10 + id % 15, '-0', 1 + id % 9, '-1', id % 10, 'T0', id % 10, ':00:0', id % 10, 'Z-', id)"),
        (0, "concat(element_at(array('key:', 'token:', 'password:', 'login =', 'auth ='), cast(1 + (id div 29) % 5 as int)), ' ', element_at(array('required', 'optional', 'forgotten', 'section', 'response', 'welcome', 'customer'), cast(1 + (id div 100) % 7 as int)))"),
    ]
    kinds += [
        (1, f"concat('{{\"user\":\"name', id % 7, '\",\"', element_at(array('token', 'api_key', 'password', 'secret'), cast(1 + (id div 29) % 4 as int)), '\":\"', substring({b}, 1, cast(16 + (id div 29) % 20 as int)), '\",\"size\":', id, '}}')"),
        (1, f"concat('https://api.example.com/v1/list?', element_at(array('key', 'token', 'access_token', 'auth'), cast(1 + (id div 29) % 4 as int)), '=', substring({h}, 1, 32), '&lang=en')"),
        (1, f"concat('postgres://user', id % 5, ':', substring({b}, 1, cast(9 + (id div 29) % 12 as int)), '@db.example.com/main')"),
        (1, f"concat('-----BEGIN ', element_at(array('RSA ', '', 'EC '), cast(1 + id % 3 as int)), 'PRIVATE KEY-----\n', {line}, '\n', {line}, '\n-----END PRIVATE KEY-----')"),
        (0, f"concat('-----BEGIN ', element_at(array('PUBLIC KEY', 'CERTIFICATE'), cast(1 + id % 2 as int)), '-----\n', {line}, '\n-----END CERTIFICATE-----')"),
        (0, f"concat('{{\"commit\":\"', substring({h}, 1, 40), '\",\"size\":', id, '}}')"),
        (0, f"concat('https://www.example.com/page', id, '/list?ref=', substring({h}, 1, 8), '&session_view=section', id, 'overview')"),
        (0, f"concat('item', id, ',', lpad(conv(substring({h}, 1, 13), 16, 10), 16, '5'), ',2019-01-0', 1 + id % 9, ',https://www.example.com/a', id, '/index.html')"),
        (0, f"concat('user', id % 50, '.name', id % 9, '@mail', id % 7, '.example.org, user', id % 5, '@example.com')"),
    ]
    text = "case id % 29 " + " ".join(f"when {i} then {sql}" for i, (_, sql) in enumerate(kinds)) + " end"
    y = "case " + " ".join(f"when id % 29 = {i} then {label}" for i, (label, _) in enumerate(kinds)) + " end"
    path = "if(id % 11 = 0, 'docs/example.md', concat('src', id % 13))"
    return spark.range(rows).select(F.expr(f"concat({lead}, ' ', {text}, ' ', {lead})").alias("text"), F.expr(path).alias("path"), F.expr(y).alias("y"))


def _tree_sql(node: object) -> str:
    if node.getClass().getSimpleName() != "InternalNode":
        return f"{node.prediction():.1f}D"
    split = node.split()
    return f"if(f.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {_tree_sql(node.leftChild())}, {_tree_sql(node.rightChild())})"


def forest(spark: SparkSession) -> str:
    """SQL of the score of ``f``: the share of the forest's trees that vote for a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled_findings(spark).select("y", F.explode(F.expr(_per_candidate("f"))).alias("f")).select("f.*", F.col("y").cast("double").alias("label")).coalesce(1)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=3).fit(vectors)
    return f"({' + '.join(_tree_sql(tree._call_java('rootNode')) for tree in model.trees)}) / {len(model.trees)}D"


def _scored(docs: DataFrame, path: str | None) -> DataFrame:
    """docs with ``scan``: an array of position, finding, score for each candidate."""
    score = forest(docs.sparkSession)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = f"named_struct('position', c.position, 'finding', v, 'score', {score})"
    scan = F.expr(_per_candidate(inner))
    return docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), where.alias("path")).withColumn("scan", scan)


def findings(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """Per candidate: doc_id, position (of its piece, from 0; a block: -1), finding, score, is_secret."""
    scored = _scored(docs.select("doc_id", "text", *[path] * bool(path)), path)
    out = scored.select(F.col("row.doc_id").alias("doc_id"), F.explode("scan").alias("x")).select("doc_id", "x.*")
    return out.withColumn("is_secret", F.col("score") >= THRESHOLD)


def redact(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """docs with every secret replaced by a mark wherever it stands as a whole value, and n_chars to match where there is such a column; no row goes."""
    scored = _scored(docs, path)
    # Longest first, so that none is left as the rest of another; blocks are longer than what they hold.
    secrets = F.expr(f"array_sort(array_distinct(transform(filter(scan, x -> x.score >= {THRESHOLD}), x -> x.finding)), (a, b) -> case when length(a) <> length(b) then length(b) - length(a) when a < b then -1 when a > b then 1 else 0 end)")
    alone = lambda s: F.concat(F.lit(BEFORE + "\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E" + AFTER))
    hidden = lambda t, s: F.when(F.startswith(s, F.lit("-----BEGIN")), F.replace(t, s, F.lit(FINDING))).otherwise(F.regexp_replace(t, alone(s), F.lit(FINDING)))
    out = scored.withColumn("secrets", secrets).withColumn("clean", F.aggregate("secrets", F.col("text"), hidden))
    changed = F.size("secrets") > 0
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["text"] = F.when(changed, F.col("clean")).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[v.alias(c) for c, v in columns.items()])
