"""Narratives, chunks, retrieval, groundedness, case files and streams on the given tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from causalrisk.catalog.common import Catalog, q4, r4, rounded, with_tables
from causalrisk.catalog.models import REASONS, with_reasons
from causalrisk.functions.fixed_values import BAND_ACTIONS, GLOSSARY, GROUNDED_VERDICTS, STOP_WORDS
from causalrisk.functions.text import chunk_rows, plain_name, three_digits
from causalrisk.operators import narrative as nr, retrieve as rt
from causalrisk.operators.explain import top_reasons
from causalrisk.operators.latent import LatentVectors
from causalrisk.operators.vector_index import VectorIndex
from causalrisk.plans.investigate import build_cases, investigate
from causalrisk.session import materialise
from causalrisk.sources.corpus import title_of
from causalrisk.sources.tables import lineitems, read_table, spread_table

CATALOG = Catalog()
add = CATALOG.add


# ---------------------------------------------------------------- narratives ---
@add("""
    WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS a, l_discount AS b, (l_tax - 0.045) / 1000 AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, format('{:.3g}', a) AS price, format('{:.3g}', b) AS discount, format('{:.3g}', c) AS small FROM v
""")
def three_digit_numbers(spark, folder):
    return lineitems(spark, folder).select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
        three_digits(F.col("l_extendedprice")).alias("price"), three_digits(F.col("l_discount")).alias("discount"),
        three_digits((F.col("l_tax") - 0.045) / 1000).alias("small"),
    )


NAMES = [*GLOSSARY, "D1_isna", "dist1_isna", "foo_isna", "id_30_freq", "DeviceType_freq", "V257", "V1_isna", "amount"]


def _glossary_sql(column: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GLOSSARY.items())
    return f"CASE {column} {cases} END"


def _plain_sql(f: str) -> str:
    base = f"regexp_replace({f}, '_(isna|freq)$', '')"
    return f"""coalesce({_glossary_sql(f)}, CASE WHEN {f} LIKE '%\\_isna' ESCAPE '\\' THEN 'missing ' || coalesce({_glossary_sql(base)}, {base})
        WHEN {f} LIKE '%\\_freq' ESCAPE '\\' THEN 'how common ' || coalesce({_glossary_sql(base)}, {base}) || ' is'
        WHEN {f} LIKE 'V%' THEN 'anonymised behavioural signal ' || {f} ELSE {f} END)"""


@add(f"""
    WITH n AS (SELECT [{', '.join(repr(n) for n in NAMES)}] AS names),
    e AS (SELECT event_id, names[1 + event_id % {len(NAMES)}] AS feature FROM events, n)
    SELECT feature, {_plain_sql('feature')} AS plain, count(*) AS n FROM e GROUP BY 1, 2
""")
def plain_feature_names(spark, folder):
    names = F.array(*map(F.lit, NAMES))
    feature = F.element_at(names, (F.col("event_id") % len(NAMES) + 1).cast("int"))
    rows = read_table(spark, folder, "events").select(feature.alias("feature"))
    return rows.groupBy("feature", plain_name(F.col("feature")).alias("plain")).agg(F.count(F.lit(1)).alias("n"))


@add(with_tables(f"""
    WITH x AS (SELECT txn_id, ' ' || lower(CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM'
        WHEN score >= 0.15 THEN 'LOW' ELSE 'NONE' END) AS band FROM scored)
    SELECT txn_id, band, CASE upper(trim(band)) {' '.join(f"WHEN '{b}' THEN '{a}'" for b, (a, _) in BAND_ACTIONS.items())} END AS required_action,
           CASE upper(trim(band)) {' '.join(f"WHEN '{b}' THEN '{o}'" for b, (_, o) in BAND_ACTIONS.items())} END AS owner,
           CASE WHEN upper(trim(band)) = 'NONE' THEN 'unknown risk band ''' || band || '''; valid: {', '.join(sorted(BAND_ACTIONS))}' END AS error FROM x
""", "scored"))
def required_actions(spark, folder):
    """Actions looked up from untidy band names, one of them unknown."""
    p = F.col("score")
    band = F.when(p >= 0.9, "critical").when(p >= 0.7, "high").when(p >= 0.4, "medium").when(p >= 0.15, "low").otherwise("none")
    rows = with_reasons(spark, folder).select("txn_id", F.concat(F.lit(" "), band).alias("band"))
    return nr.required_action(rows, "band")


_ACTION = "CASE risk_band " + " ".join(f"WHEN '{b}' THEN '{a}'" for b, (a, _) in BAND_ACTIONS.items()) + " END"


def _joined_sql(items: str) -> str:
    return f"CASE WHEN len({items}) = 1 THEN {items}[1] ELSE array_to_string({items}[:-2], ', ') || ' and ' || {items}[-1] END"


@add(with_tables(f"""WITH {REASONS},
    d AS (SELECT txn_id, position, c, {_plain_sql('feature')} || ' = ' || coalesce(format('{{:.3g}}', value), 'not recorded') AS text FROM top),
    up AS (SELECT txn_id, list(text ORDER BY position) AS u FROM d WHERE c > 0 GROUP BY txn_id),
    down AS (SELECT txn_id, list(text ORDER BY position)[1:2] AS w FROM d WHERE c < 0 GROUP BY txn_id),
    a AS (SELECT s.txn_id, s.amount, s.channel, s.band, s.score AS p, u, w, CASE WHEN s.score >= 0.9 THEN 'CRITICAL'
        WHEN s.score >= 0.7 THEN 'HIGH' WHEN s.score >= 0.4 THEN 'MEDIUM' WHEN s.score >= 0.15 THEN 'LOW' ELSE 'MINIMAL' END AS risk_band
        FROM scored s LEFT JOIN up USING (txn_id) LEFT JOIN down USING (txn_id))
    SELECT txn_id, risk_band, concat_ws(' ', 'ALERT ' || txn_id || ' | risk ' || risk_band || format(' ({{:.1f}}%)', p * 100) || format(' | amount {{:,.2f}}', amount),
        'Context: ' || concat_ws(', ', 'channel=' || channel, 'band=' || band) || '.',
        'The model raised this alert primarily because of ' || {_joined_sql('u')} || '.',
        'Reducing the score: ' || {_joined_sql('w')} || '.',
        'Recommended action: ' || {_ACTION} || '.',
        '[machine-generated from model output; not an analyst write-up]') AS narrative
    FROM a
""", "scored"))
def narratives(spark, folder):
    """A narrative for every transaction."""
    rows = with_reasons(spark, folder).withColumn("p", F.col("score"))
    rows = rows.withColumn("reasons", top_reasons(F.col("reasons")))
    made = nr.narrate(rows, "txn_id", "p", "amount", "reasons", ("channel", "band"))
    return made.select("txn_id", "risk_band", "narrative")


@add(with_tables(f"""SELECT txn_id, {q4('score')} AS score FROM scored ORDER BY scored.score DESC, txn_id LIMIT 2000""", "scored"))
def top_alerts(spark, folder):
    return rounded(nr.top_alerts(with_reasons(spark, folder), "score", "txn_id").select("txn_id", "score"))


@add(with_tables(f"SELECT arg_max(txn_id, score * 1e7 - txn_id * 1e-7) AS txn_id, {q4('max(score)', 6)} AS score FROM scored", "scored"))
def strongest_alert(spark, folder):
    best = with_reasons(spark, folder).agg(
        F.max_by("txn_id", F.struct("score", -F.col("txn_id"))).alias("txn_id"), F.max("score").alias("score"))
    return rounded(best, score=6)


@add(with_tables(f"""WITH {REASONS},
    n AS (SELECT txn_id, list({_plain_sql('feature')} ORDER BY position) AS names FROM top WHERE c > 0 GROUP BY txn_id)
    SELECT q AS query, count(*) AS n FROM (SELECT CASE WHEN names IS NULL THEN 'high risk fraud alert'
        ELSE 'fraud alert driven by ' || array_to_string(names[1:3], ', ') END AS q FROM scored LEFT JOIN n USING (txn_id)) GROUP BY 1""", "scored"))
def similarity_queries(spark, folder):
    rows = with_reasons(spark, folder)
    query = nr.similarity_text(top_reasons(F.col("reasons")))
    return rows.groupBy(query.alias("query")).agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------- chunks, search ---
@add("""
    WITH w AS (SELECT doc_id, text, regexp_split_to_array(trim(text, E' \\t\\n\\r'), '\\s+') AS words FROM documents),
    c AS (SELECT doc_id, unnest(range(0, CASE WHEN len(words) <= 180 THEN 1 ELSE CAST(ceil((len(words) - 180) / 140) AS BIGINT) + 1 END)) AS chunk, words, text FROM w)
    SELECT doc_id, chunk, CASE WHEN len(words) <= 180 THEN trim(text, E' \\t\\n\\r') ELSE array_to_string(words[chunk * 140 + 1 : chunk * 140 + 180], ' ') END AS text
    FROM c WHERE trim(text, E' \\t\\n\\r') <> ''
""")
def document_chunks(spark, folder):
    made = chunk_rows(spread_table(spark, folder, "documents", "doc_id"), "text", ["doc_id"])
    return made.withColumn("chunk", F.col("chunk").cast("long"))


@add(r"""
    SELECT doc_id, trim(regexp_replace(regexp_extract(text, '^([^\r\n]*)', 1), '^[# ]+', '')) AS title FROM documents
""")
def document_titles(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", title_of(F.col("text")).alias("title"))


@add(f"""
    SELECT vec_id, {q4('sqrt(list_sum(list_transform(u, lambda x: x * x)))')} AS norm, {q4('u[1]')} AS first FROM (
        SELECT vec_id, list_transform(e, lambda x: x / n) AS u FROM (
            SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings))
""")
def unit_vectors(spark, folder):
    rows = read_table(spark, folder, "embeddings").select("vec_id", rt.unit_length(F.col("embedding")).alias("u"))
    return rounded(rows.select(
        "vec_id", F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"), F.col("u")[0].alias("first")))


_NEAREST = f"""
    WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(sim * 1e10 + 0.5) DESC, corpus_id) AS rank FROM s)
    SELECT query_id, corpus_id, {q4('sim')} AS similarity, rank FROM r WHERE rank <= 5
"""


@add(_NEAREST)
def cosine_top_k(spark, folder):
    """The five nearest vectors of every vector."""
    rows = read_table(spark, folder, "embeddings")
    return rounded(rt.cosine_top_k(rows, rows, "vec_id", "vec_id", 5, "embedding", "embedding"))


@add(_NEAREST)
def indexed_top_k_of_all_cells(spark, folder):
    """The five nearest vectors of every vector by the inverted file with all cells probed, which is exact."""
    rows = read_table(spark, folder, "embeddings")
    index = VectorIndex.fit(rows, "vec_id", "embedding")
    return rounded(index.search(rows, "vec_id", "embedding", 5, index.cells))


@add("SELECT count(*) AS n_queries, 10 * count(*) AS n_exact, 1 AS reached, 1 AS reads_less FROM embeddings WHERE vec_id % 100 = 0")
def index_recall(spark, folder):
    """Whether the fewest probes chosen on the asked queries find nine of ten neighbours of every hundredth vector, reading less than all rows."""
    rows = read_table(spark, folder, "embeddings")
    asked = rows.where(F.col("vec_id") % 100 == 0)
    index = VectorIndex.fit(rows, "vec_id", "embedding")
    probes = index.probes_for(rows, "vec_id", "embedding", asked, "vec_id", "embedding", 10)
    exact = rt.cosine_top_k(asked, rows, "vec_id", "vec_id", 10, "embedding", "embedding")
    recall = index.recall(exact, asked, "vec_id", "embedding", 10, probes)
    read = index.rows_read(asked, "vec_id", "embedding", probes)
    return rounded(read.crossJoin(rows.agg(F.count("*").alias("all"))).select(
        F.col("queries").alias("n_queries"), exact.agg(F.count("*")).scalar().alias("n_exact"), F.lit(recall >= 0.9).cast("int").alias("reached"),
        (F.col("mean_rows") < F.col("all")).cast("int").alias("reads_less"),
    ))


@add(f"""
    WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
    q AS (SELECT label::BIGINT AS label, list(x ORDER BY i) AS v FROM m GROUP BY label),
    r AS (SELECT label AS query_id, vec_id AS corpus_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS sim FROM q, (SELECT vec_id, embedding FROM embeddings)),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(sim * 1e10 + 0.5) DESC, corpus_id) AS rank FROM r)
    SELECT query_id, corpus_id, {q4('sim')} AS similarity, rank FROM k WHERE rank <= 10
""")
def nearest_to_centroids(spark, folder):
    """The ten vectors nearest to the mean vector of each label."""
    rows = read_table(spark, folder, "embeddings")
    means = (
        rows.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    )
    return rounded(rt.cosine_top_k(means, rows, "label", "vec_id", 10, "v", "embedding"))


def _passages(spark, folder):
    docs = read_table(spark, folder, "documents")
    # Always dealt out: splits of a file may hold no rows, and whoever reads the passages works in the tasks that wrote them.
    tasks = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    docs = docs.select("doc_id", "text").repartition(tasks, "doc_id", "text").select(F.col("doc_id").cast("string").alias("source"), "text")
    return chunk_rows(docs, "text", ["source"]).withColumn(
        "passage_id", F.concat_ws("#", "source", F.format_string("%05d", "chunk")))


def retrieved(spark, folder, k=4):
    """The passages nearest to every benchmark text, by shared weighted words."""
    passages = materialise(_passages(spark, folder), "passages")
    model = rt.fit_text_vectors(passages, "text")
    questions = read_table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"))
    hits = rt.cosine_top_k(
        rt.text_vectors(model, questions, "question"), rt.text_vectors(model, passages, "text"), "item_id", "passage_id", k)
    return hits.join(passages, F.col("corpus_id") == F.col("passage_id")).join(
        questions, F.col("query_id") == F.col("item_id"))


@add()
def passage_retrieval(spark, folder):
    return retrieved(spark, folder).select("item_id", "rank", "source", "chunk", "similarity")


@add()
def retrieval_hit_rates(spark, folder):
    """Per kind of vector: benchmark texts, and those with a passage among the four nearest that holds their first eight words."""
    passages = materialise(_passages(spark, folder), "passages")
    questions = read_table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"))
    lexical, latent = rt.fit_text_vectors(passages, "text"), LatentVectors.fit(passages, "text")
    made = {
        "lexical": (rt.text_vectors(lexical, questions, "question"), rt.text_vectors(lexical, passages, "text")),
        "latent": (latent.transform(questions, "question"), materialise(latent.transform(passages, "text").select("passage_id", "vector"), "latent")),
    }
    plain = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)), " ")
    out = None
    for kind, (asked, known) in made.items():
        # Stored, so that the join knows how few they are and need not deal out all passages.
        hits = materialise(rt.cosine_top_k(asked, known, "item_id", "passage_id", 4), f"{kind}-hits")
        hits = hits.join(passages, F.col("corpus_id") == F.col("passage_id")).join(questions, F.col("query_id") == F.col("item_id"))
        start = F.array_join(F.slice(F.split(plain(F.col("question")), " "), 1, 8), " ")
        found = hits.where(F.contains(plain(F.col("text")), start)).select("item_id").distinct()
        row = questions.agg(F.count("*").alias("n_items")).select(F.lit(kind).alias("kind"), "n_items", found.agg(F.count("*")).scalar().alias("n_found"))
        out = row if out is None else out.unionByName(row)
    return out


@add()
def retrieval_prompts(spark, folder):
    return rt.prompts(retrieved(spark, folder), "item_id", "question", "rank", "source", "text")


_PLACE = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) "


@add("""
    WITH h AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)
    SELECT conv_id, '' || 'POLICY CONTEXT' || chr(10) || '==============' || chr(10)
        || string_agg('--- SOURCE ' || rank || ': [' || role || '] ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)
        || chr(10) || chr(10) || '==============' || chr(10) || 'Using ONLY the policy context above, answer this question.' || chr(10)
        || 'Cite the source file for each claim. If the context does not contain' || chr(10)
        || 'the answer, say "The provided policy does not cover this."' || chr(10) || chr(10) || 'QUESTION: conversation ' || conv_id || chr(10) AS prompt,
        array_to_string(list_sort(list_distinct(list(role))), ',') AS sources, count(*) AS chunks_used
    FROM h GROUP BY conv_id
""")
def prompt_layout(spark, folder):
    """The prompt format, with the turns of a conversation as its sources."""
    ranked = Window.partitionBy("conv_id").orderBy("turn")
    hits = read_table(spark, folder, "conversations").withColumn("rank", F.row_number().over(ranked))
    hits = hits.withColumn("question", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))
    made = rt.prompts(hits, "conv_id", "question", "rank", "role", "text")
    return made.withColumn("sources", F.array_join("sources", ","))


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _verdict_sql(ratio: str) -> str:
    return "CASE " + " ".join(f"WHEN {ratio} >= {limit} THEN '{text}'" for limit, text in GROUNDED_VERDICTS) + " END"


@add(f"""
    WITH w AS (SELECT conv_id, turn, role, text, list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda x: NOT list_contains({_STOP}, x)) AS words FROM conversations),
    c AS (SELECT a.conv_id, a.turn, any_value(a.words) AS words, coalesce(flatten(list(b.words) FILTER (b.words IS NOT NULL)), []) AS ctx,
                 any_value(lower(trim(a.text))) AS low
          FROM w a LEFT JOIN w b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'assistant' GROUP BY 1, 2),
    s AS (SELECT *, list_filter(words, lambda x: NOT list_contains(ctx, x)) AS missing,
                 (low LIKE '%does not cover this%' OR low LIKE '%not covered by the provided%' OR low LIKE '%cannot answer from the provided%') AND length(low) < 200 AS refused FROM c)
    SELECT conv_id, turn, CASE WHEN refused THEN 1.0 WHEN len(words) = 0 THEN 0.0 ELSE {q4('round_even((len(words) - len(missing)) / len(words), 3)')} END AS grounded_ratio,
           CASE WHEN refused OR len(words) = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(missing))[1:10], ' ') END AS unsupported,
           CASE WHEN refused THEN 'correct refusal - the model declined to answer outside the retrieved context, which is the desired safety behaviour'
                WHEN len(words) = 0 THEN 'empty answer' ELSE {_verdict_sql('(len(words) - len(missing)) / len(words)')} END AS verdict
    FROM s
""")
def groundedness(spark, folder):
    """Every assistant turn against all earlier turns of its conversation."""
    turns = spread_table(spark, folder, "conversations", "conv_id").withColumn(
        "turn_id", F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    answers = turns.filter(F.col("role") == "assistant")
    made = rt.groundedness(answers, turns, "turn_id", "text", "conv_id", "text", "turn", "turn")
    parts = F.split("turn_id", "#")
    return rounded(made.select(
        parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), "grounded_ratio",
        F.array_join("unsupported_terms", " ").alias("unsupported"), "verdict"))


@add()
def case_files(spark, folder):
    """Facts, score, drivers, precedents, action and passages for the top alerts."""
    rows = with_reasons(spark, folder)
    docs = spread_table(spark, folder, "documents", "doc_id").select(F.col("doc_id").cast("string").alias("source"), "text")
    base = build_cases(rows, "txn_id", "score", "amount", "label", "reasons", docs, ("channel", "band"))
    made = investigate(rows, base, ("amount", "channel", "hour"), "txn_id", "score", "reasons")
    return made.select(
        "id", "probability", "risk_band", "required_action", "owner",
        F.size("drivers").alias("n_drivers"), F.size("similar").alias("n_similar"), F.size("passages").alias("n_passages"),
        F.to_json("found").alias("found"),
    )
