"""Texts, vocabulary, discovery over the documents and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papyrine.functions import text as tx
from papyrine.functions.measures import rate, width_of_crossing
from papyrine.operators import corpus, discovery, relational as rel, vocabulary as voc
from papyrine.plans.catalog import Tables, query
from papyrine.plans.triage import TOKENS
from papyrine.session import dealt, stored
from papyrine.sources import records

#: Words with the blanks behind them, numbered; a sentence begins at a word with a capital or bracket after one that closes.
SENTENCES = """w AS (SELECT {id} AS id, u.w, u.i FROM {table}, unnest(regexp_extract_all({text}, '\\S+\\s*')) WITH ORDINALITY AS u(w, i)),
b AS (SELECT *, CASE WHEN i = 1 OR (ascii(w) BETWEEN 65 AND 90 OR w[1] = '(') AND right(regexp_replace(lag(w) OVER (PARTITION BY id ORDER BY i), '\\s+$', ''), 1) IN ('.', '!', '?') THEN 1 ELSE 0 END AS starts FROM w),
n AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY i) AS s FROM b),
sentence AS (SELECT id, s, regexp_replace(string_agg(w, '' ORDER BY i), '\\s+$', '') AS sentence FROM n GROUP BY id, s)"""


@query(f"""WITH {SENTENCES.format(id='doc_id', table='documents', text='text')}
SELECT id AS doc_id, sentence FROM sentence WHERE length(sentence) BETWEEN 60 AND 400 AND regexp_matches(lower(sentence), '(^|[^a-z0-9_])(the|was|heble)([^a-z0-9_]|$)')""")
def gap_sentences(t: Tables) -> DataFrame:
    found = tx.gap_sentences(F.col("text"), ("the", "was", "heble"))
    return t.documents.select("doc_id", F.explode(found).alias("sentence"))


@query("SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS body, length(html) - length(replace(html, '<', '')) AS n_tags FROM pages")
def html_sections(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.nullif(tx.clean(F.col("html")), F.lit("")).alias("body"), (F.length("html") - F.length(F.replace("html", F.lit("<"), F.lit("")))).cast("long").alias("n_tags"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ') AS text FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 0")
def inverted_abstract(t: Tables) -> DataFrame:
    """The index of a document is made in its row: none of its words is shuffled."""
    words = t.documents.select("doc_id", F.filter(F.split("text", " "), lambda w: w != "").alias("ws"))
    index = words.where(F.size("ws") > 0).select("doc_id", tx.inverted(F.col("ws")).alias("index"))
    return index.select("doc_id", tx.from_inverted(F.col("index")).alias("text"))


@query("""SELECT page_id, lower(regexp_replace(url, '^(https?://)?(dx\\.)?(doi\\.org/)?', '')) AS doi, left(regexp_replace(lower(url), '[^a-z0-9]+', '', 'g'), 110) AS key, lower(regexp_replace(url, '\\s+', ' ', 'g')) AS topic,
'(' || url || ') AND 1990:3000[dp]' AS clause, len(string_split(url, '.')) AS depth FROM pages""")
def text_keys(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", tx.doi(u).alias("doi"), tx.squashed(u).alias("key"), tx.one_space(u).alias("topic"), tx.year_clause(u, F.lit(1990), F.lit(None).cast("int")).alias("clause"), tx.path_depth(u).alias("depth"))


@query("SELECT item_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM benchmark")
def title_keys(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", tx.title_key(F.col("text")).alias("title_key"))


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS doi, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS pmid, p_name AS title FROM part)
SELECT id, coalesce(lower(doi), 'pmid:' || pmid, left(lower(title), 120)) AS key, CASE WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi WHEN pmid IS NOT NULL THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' END AS link FROM p""")
def identity_keys(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("doi"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).alias("pmid"), F.col("p_name").alias("title"))
    return p.select("id", tx.identity(F.col("doi"), F.col("pmid"), F.col("title")).alias("key"), tx.link(F.col("doi"), F.col("pmid")).alias("link"))


LABEL = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('of', 'the', 'and', 'in', 'or'))"
LABELS = f"b AS (SELECT DISTINCT p_type AS label FROM part), l AS (SELECT label, {LABEL.format('label')} AS l, substr(label, 1, 2) || '.' || substr(label, -3) AS path FROM b), q AS (SELECT DISTINCT p_type AS term FROM part), s AS (SELECT term, {LABEL.format('term')} AS t FROM q)"
SCORE = "CASE WHEN t = l THEN 100 WHEN list_sort(t) = list_sort(l) THEN 90 WHEN l[1:len(t)] = t THEN 80 WHEN list_has_all(l, t) THEN 70 WHEN list_has_any(l, t) THEN 40 ELSE 0 END"


def label_frames(t: Tables) -> tuple[DataFrame, DataFrame]:
    labels = t.part.select(F.col("p_type").alias("label")).distinct()
    labels = labels.select(F.col("label").alias("ui"), "label", tx.label_tokens(F.col("label")).alias("l"), F.concat(F.substring("label", 1, 2), F.lit("."), F.substring("label", -3, 3)).alias("path"))
    terms = t.part.select(F.col("p_type").alias("term")).distinct()
    return terms.select("term", tx.label_tokens(F.col("term")).alias("t")), labels


@query(f"WITH {LABELS} SELECT term, label, {SCORE} AS score FROM s JOIN l ON list_has_any(t, l)")
def label_scores(t: Tables) -> DataFrame:
    terms, labels = label_frames(t)
    return voc.ranked(terms, labels).select("term", "label", "score")


@query(f"""WITH {LABELS}, c AS (SELECT term, label AS ui, label, path, {SCORE} AS score FROM s JOIN l ON list_has_any(t, l)), h AS (SELECT *, first_value(path) OVER (PARTITION BY term ORDER BY score DESC, length(label), ui) AS ref FROM c),
n AS (SELECT *, CASE WHEN path = ref THEN 2 WHEN split_part(path, '.', 1) = split_part(ref, '.', 1) THEN 1 ELSE 0 END AS near FROM h), z AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, near DESC, length(label), ui) AS place FROM n) SELECT term, ui, near, place FROM z WHERE place <= 8""")
def vocab_rank(t: Tables) -> DataFrame:
    terms, labels = label_frames(t)
    return voc.ranked(terms, labels).where("place <= 8").select("term", "ui", "near", "place")


@query("""WITH l AS (SELECT p_partkey AS ui, p_type AS label FROM part), q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE replace(p_type, ' ', '-') END AS term FROM part),
m AS (SELECT DISTINCT term, ui, CASE WHEN lower(term) = lower(label) THEN 1 ELSE 2 END AS rung FROM q JOIN l ON regexp_replace(lower(term), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(label), '[^a-z0-9]+', '', 'g')), z AS (SELECT *, min(rung) OVER (PARTITION BY term) AS b FROM m)
SELECT term, ui, rung FROM z WHERE rung = b""")
def lookup_cascade(t: Tables) -> DataFrame:
    labels = t.part.select(F.col("p_partkey").alias("ui"), F.col("p_type").alias("label"))
    terms = t.part.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("term")).distinct()
    return voc.cascade(terms, labels).select("term", "ui", "rung")


@query("""WITH v AS (SELECT s_nationkey AS plan, s_suppkey % 3 AS c, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_suppkey) - 1 AS place, 't' || s_suppkey AS term FROM supplier),
k AS (SELECT plan FROM v GROUP BY plan HAVING count(DISTINCT c) = 3), x AS (SELECT a.plan, a.place + b.place + d.place AS total, a.term || ' AND ' || b.term || ' AND ' || d.term AS query, [a.term, b.term, d.term] AS terms FROM k JOIN v a ON a.plan = k.plan AND a.c = 0 AND a.place < 3 JOIN v b ON b.plan = k.plan AND b.c = 1 AND b.place < 3 JOIN v d ON d.plan = k.plan AND d.c = 2 AND d.place < 3),
z AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY total, terms) AS n FROM x) SELECT plan, total, query FROM z WHERE n <= 8""")
def query_plan(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    c = F.col("s_suppkey") % 3
    v = t.supplier.select(F.col("s_nationkey").alias("plan"), c.cast("int").alias("concept"), (F.row_number().over(Window.partitionBy("s_nationkey", c).orderBy("s_suppkey")) - 1).alias("place"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("term"))
    whole = v.groupBy("plan").agg(F.count_distinct("concept").alias("n")).where("n = 3").select("plan")
    return voc.crossed(v.join(whole, "plan", "left_semi"), 8)


@query("""SELECT p_brand AS id, '(' || string_agg('"' || p_type || '"', ' OR ' ORDER BY p_type) || ')' AS query, CAST(greatest(2, round_even(pow(12, 1.0 / (1 + count(*) % 4)), 0) + 1) AS INT) AS width FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand""")
def render_query(t: Tables) -> DataFrame:
    g = t.part.select("p_brand", "p_type").distinct().groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_list("p_type")).alias("terms"), F.count("*").alias("n"))
    return g.select("id", tx.any_of(F.array("terms")).alias("query"), width_of_crossing(12, 1 + F.col("n") % 4).alias("width"))


WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-zà-öø-ÿ0-9]+'), lambda x: x <> '')"


def words(c):
    return F.filter(F.split(F.lower(c), "[^a-zà-öø-ÿ0-9]+"), lambda x: x != "")


MOST = 6


def dictionary(t: Tables, n: int = MOST) -> DataFrame:
    """Runs of one, two and `n` words at the head of each benchmark passage as terms."""
    w = words(F.col("text"))
    heads = t.benchmark.select("item_id", F.explode(F.array(F.array_join(F.slice(w, 1, n), " "), F.array_join(F.slice(w, 2, 2), " "), F.array_join(F.slice(w, 1, 1), " "))).alias("gram"))
    return heads.where("gram <> ''").groupBy("gram").agg(F.concat(F.lit("u"), F.min("item_id").cast("string")).alias("ui"), (F.min("item_id") % 4 != 0).alias("informative"))


DICTIONARY = f"""h AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark), e AS (SELECT item_id, unnest([array_to_string(w[1:6], ' '), array_to_string(w[2:3], ' '), w[1]]) AS gram FROM h),
dict AS (SELECT gram, 'u' || min(item_id) AS ui, min(item_id) % 4 <> 0 AS informative FROM e WHERE gram <> '' GROUP BY gram),
d AS (SELECT doc_id AS id, {WORDS.format('text')} AS w FROM documents), s AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
g AS (SELECT id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS gram FROM s, (SELECT DISTINCT len(string_split(gram, ' ')) AS n FROM dict) x WHERE pos + n - 1 <= len(w)), m AS (SELECT id, pos, n, gram, ui, informative FROM g JOIN dict USING (gram)), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, pos ORDER BY n DESC) = 1)"""


def extracted(t: Tables) -> DataFrame:
    return voc.concepts(t.documents.select(F.col("doc_id").alias("id"), "text"), words(F.col("text")), dictionary(t), MOST)


@query(f"""WITH RECURSIVE {DICTIONARY}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM b),
r AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS next, false AS taken, CAST(0 AS BIGINT) AS pos, '' AS gram, '' AS ui, false AS informative FROM (SELECT DISTINCT id FROM o)
UNION ALL SELECT o.id, o.k, CASE WHEN o.pos >= r.next THEN o.pos + o.n ELSE r.next END, o.pos >= r.next, o.pos, o.gram, o.ui, o.informative FROM r JOIN o ON o.id = r.id AND o.k = r.k + 1)
SELECT id, CAST(pos AS INT) AS pos, gram, ui FROM r WHERE taken AND informative""")
def concept_extract(t: Tables) -> DataFrame:
    return extracted(t).withColumnRenamed("at", "pos")


@query(f"WITH {DICTIONARY}, c AS (SELECT ui, count(DISTINCT id) AS df FROM m GROUP BY ui), n AS (SELECT count(*) AS n FROM documents) SELECT ui, df, round(df / n, 6) AS share, df / n > 0.02 AS is_generic FROM c, n")
def generic_filter(t: Tables) -> DataFrame:
    found = voc.matches(t.documents.select(F.col("doc_id").alias("id"), "text"), words(F.col("text")), dictionary(t), MOST)
    counts = found.select("id", "ui").distinct().groupBy("ui").agg(F.count("*").alias("df"))
    return voc.generic(counts.join(F.broadcast(t.documents.agg(F.count("*").alias("n")))), F.col("n")).drop("n")


@query(f"""WITH {DICTIONARY}, c AS (SELECT DISTINCT id, ui FROM m), x AS (SELECT ui, id, left(text, 20) AS title, row_number() OVER (PARTITION BY ui ORDER BY left(text, 20), id) AS k FROM c JOIN documents ON doc_id = id)
SELECT ui, count(*) AS n_docs, string_agg(title, ' | ' ORDER BY title) FILTER (WHERE k <= 3) AS examples FROM x GROUP BY ui""")
def concept_rank(t: Tables) -> DataFrame:
    found = voc.matches(t.documents.select(F.col("doc_id").alias("id"), "text"), words(F.col("text")), dictionary(t), MOST)
    return voc.ranked_concepts(found, t.documents.select(F.col("doc_id").alias("id"), F.left("text", F.lit(20)).alias("title")))


PATHS = "p AS (SELECT 'n' || n_nationkey AS ui, 'r' || n_regionkey || '.n' || n_nationkey AS path FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey || '.n' || n_nationkey || '.s' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def paths(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, r = t.nation, t.region
    up = F.concat(name("r", "n_regionkey"), F.lit("."), name("n", "n_nationkey"))
    s = t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return n.select(name("n", "n_nationkey").alias("ui"), up.alias("path")).unionByName(r.select(name("r", "r_regionkey").alias("ui"), name("r", "r_regionkey").alias("path"))).unionByName(s.select(name("s", "s_suppkey").alias("ui"), F.concat(up, F.lit("."), name("s", "s_suppkey")).alias("path")))


@query(f"""WITH {PATHS}, {DICTIONARY}, k AS (SELECT DISTINCT path FROM p), t AS (SELECT ui, path FROM dict JOIN k ON substr(ui, 2)::INT % 40 = length(path) + ascii(right(path, 1)) % 20),
dp AS (SELECT ui, max(len(string_split(path, '.'))) AS depth FROM t GROUP BY ui), c AS (SELECT ui, count(DISTINCT id) AS df FROM m WHERE informative GROUP BY ui)
SELECT ui, df, coalesce(depth, 3) AS depth FROM c LEFT JOIN dp USING (ui) WHERE coalesce(depth, 3) >= 3 AND df <= 0.02 * (SELECT count(*) FROM documents)""")
def title_concepts(t: Tables) -> DataFrame:
    """Informative concepts that are specific by their paths and not generic, with their documents."""
    found = voc.matches(t.documents.select(F.col("doc_id").alias("id"), "text"), words(F.col("text")), dictionary(t), MOST).where("informative")
    counts = found.select("id", "ui").distinct().groupBy("ui").agg(F.count("*").alias("df"))
    some = voc.specific(counts, concept_paths(t))
    n = t.documents.agg(F.count("*").alias("n"))
    kept = voc.generic(some.join(F.broadcast(n)), F.col("n")).where("NOT is_generic").select("ui", "df")
    depth = concept_paths(t).groupBy("ui").agg(F.max(tx.path_depth(F.col("path"))).alias("depth"))
    return kept.join(depth, "ui", "left").select("ui", "df", F.coalesce("depth", F.lit(3)).alias("depth"))


def concept_paths(t: Tables) -> DataFrame:
    """The star schema's paths given to the dictionary's concepts."""
    key = F.length("path") + F.ascii(F.substring("path", -1, 1)) % 20
    nodes = paths(t).select("path", key.alias("k")).distinct()
    own = dictionary(t).select("ui", (F.substring("ui", 2, 20).cast("int") % 40).alias("k")).distinct()
    return own.join(nodes, "k").select("ui", "path")


@query(f"""WITH {PATHS}, o AS (SELECT DISTINCT ui, split_part(path, '.', 1) AS root FROM p), x AS (SELECT a.ui AS a, b.ui AS b FROM o a JOIN o b USING (root) WHERE b.ui NOT LIKE 's%')
SELECT a, b FROM x WHERE EXISTS (SELECT 1 FROM p i JOIN p j ON i.path = j.path OR i.path LIKE j.path || '.%' OR j.path LIKE i.path || '.%' WHERE i.ui = a AND j.ui = b)""")
def branch_pairs(t: Tables) -> DataFrame:
    """Of each node and the nations and regions under its root, those on one branch."""
    own = paths(t).select("ui", F.substring_index("path", ".", 1).alias("root")).distinct()
    pairs = own.withColumnRenamed("ui", "a").join(own.where("ui NOT LIKE 's%'").withColumnRenamed("ui", "b"), "root")
    return voc.on_one_branch(pairs, paths(t))


@query(f"WITH {PATHS} SELECT a.ui, b.ui AS below FROM p a JOIN p b ON b.path = a.path OR b.path LIKE a.path || '.%'")
def tree_prefix_join(t: Tables) -> DataFrame:
    return voc.descendants(paths(t))


@query(f"WITH {PATHS} SELECT a.ui, b.ui AS relative, CASE WHEN b.path LIKE a.path || '.%' THEN 'narrower' ELSE 'broader' END AS relation, len(string_split(b.path, '.')) AS depth FROM p a JOIN p b ON (b.path LIKE a.path || '.%' OR a.path LIKE b.path || '.%') AND abs(len(string_split(b.path, '.')) - len(string_split(a.path, '.'))) = 1")
def hierarchy_relatives(t: Tables) -> DataFrame:
    p = paths(t).withColumn("up", F.expr("substring_index(path, '.', size(split(path, '\\\\.')) - 1)"))
    down = p.select(F.col("path").alias("at"), F.col("ui").alias("own")).join(p.where("up <> ''").select(F.col("up").alias("at"), F.col("ui").alias("child"), "path"), "at")
    return down.select(F.col("own").alias("ui"), F.col("child").alias("relative"), F.lit("narrower").alias("relation"), tx.path_depth(F.col("path")).alias("depth")).unionByName(down.select(F.col("child").alias("ui"), F.col("own").alias("relative"), F.lit("broader").alias("relation"), tx.path_depth(F.col("at")).alias("depth")))


USES = "u AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem)"
BRIDGES = f"""WITH {USES}, sd AS (SELECT p_partkey AS item FROM part WHERE p_size = 3 AND p_brand LIKE 'Brand#1%'), ad AS (SELECT DISTINCT doc FROM u JOIN sd USING (item)), wa AS (SELECT DISTINCT item FROM u JOIN ad USING (doc)), b AS (SELECT item AS b FROM wa WHERE item NOT IN (SELECT item FROM sd)),
cb AS (SELECT y.item AS c, b.b, count(*) AS n FROM u x JOIN b ON x.item = b.b JOIN u y ON y.doc = x.doc AND y.item <> b.b WHERE y.item NOT IN (SELECT item FROM wa) AND y.item NOT IN (SELECT item FROM sd) GROUP BY ALL), br AS (SELECT c, count(*) AS ltc, CAST(sum(n) AS BIGINT) AS freq FROM cb GROUP BY c)"""


def bridged(t: Tables) -> DataFrame:
    uses = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item")).distinct()
    return discovery.bridges(uses, t.part.where("p_size = 3 AND p_brand LIKE 'Brand#1%'").select(F.col("p_partkey").alias("item")))


@query(f"{BRIDGES} SELECT c, ltc, freq FROM br")
def abc_bridges(t: Tables) -> DataFrame:
    return bridged(t)


@query()
def abc_control_rate(t: Tables) -> DataFrame:
    found = bridged(t).orderBy(F.col("ltc").desc(), F.col("freq").desc(), "c").limit(20).select(F.col("c").alias("item"), "freq")
    pool = t.lineitem.groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("freq")).join(found, "item", "left_anti")
    return discovery.matched_controls(found, pool)


CITES = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem), w AS (SELECT src AS node, count(*) AS score FROM (SELECT src FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), y AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
STEP = "s{k} AS (SELECT seed, node FROM (SELECT x.seed, x.node, row_number() OVER (PARTITION BY x.seed ORDER BY w.score DESC NULLS LAST, x.node) AS n FROM (SELECT DISTINCT seed, dst AS node FROM s{j} JOIN y ON y.src = s{j}.node EXCEPT ({seen})) x LEFT JOIN w ON w.node = x.node) WHERE n <= 4)"


@query(f"WITH {CITES}, s0 AS (SELECT p_partkey AS seed, p_partkey AS node FROM part WHERE p_size = 3), {STEP.format(k=1, j=0, seen='SELECT seed, node FROM s0')}, {STEP.format(k=2, j=1, seen='SELECT seed, node FROM s0 UNION ALL SELECT seed, node FROM s1')} SELECT *, 0 AS step FROM s0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2")
def citation_walk(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    edges = stored(dealt(rows, rows.count(), "src", "dst").distinct(), "edges")
    both = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return discovery.walk(edges, t.part.where("p_size = 3").select(F.col("p_partkey").alias("node")), 2, 4, both.groupBy("node").agg(F.count("*").alias("score")))


POSTINGS = "x AS (SELECT doc_id AS doc, unnest(list_distinct(" + TOKENS.format("text") + ")) AS term, doc_id % 2 = 0 AS is_before FROM documents)"
DIRECTIONS = "dir AS (SELECT item_id AS direction, unnest(list_distinct(" + TOKENS.format("text") + ")[1:1 + item_id % 3]) AS term FROM benchmark)"


def postings(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"), (F.col("doc_id") % 2 == 0).alias("is_before"))


def directions(t: Tables) -> DataFrame:
    """Up to three tokens of each benchmark passage, by the alphabet."""
    found = F.array_sort(F.array_distinct(tx.tokens(F.col("text"))))
    return t.benchmark.select(F.col("item_id").alias("direction"), F.explode(F.slice(found, F.lit(1), (1 + F.col("item_id") % 3).cast("int"))).alias("term"))


@query(f"""WITH {POSTINGS}, {DIRECTIONS.replace('list_distinct(', 'list_sort(list_distinct(').replace(')[1:', '))[1:')}, k AS (SELECT direction, count(*) AS n_terms FROM dir GROUP BY 1), f AS (SELECT term, count(*) AS papers FROM x GROUP BY 1),
r AS (SELECT direction, min(coalesce(papers, 0)) AS rarest FROM dir LEFT JOIN f USING (term) GROUP BY 1), h AS (SELECT direction, doc, is_before, count(*) AS held FROM dir JOIN x USING (term) GROUP BY ALL),
c AS (SELECT h.direction, count(*) FILTER (WHERE is_before) AS before, count(*) FILTER (WHERE NOT is_before) AS after FROM h JOIN k ON k.direction = h.direction AND held = n_terms GROUP BY 1)
SELECT k.direction, n_terms, rarest, coalesce(before, 0) AS before, coalesce(after, 0) AS after, CASE WHEN n_terms < 2 THEN 'SINGLE GROUP' WHEN rarest < 3 THEN 'TERM TOO RARE' WHEN coalesce(before, 0) >= 3 THEN 'ALREADY DONE' WHEN coalesce(after, 0) >= 3 THEN 'PURSUED SINCE' ELSE 'STILL OPEN' END AS verdict FROM k JOIN r USING (direction) LEFT JOIN c ON c.direction = k.direction""")
def verify_verdicts(t: Tables) -> DataFrame:
    return discovery.verdicts(directions(t), postings(t), 3, 3)


@query(f"WITH {POSTINGS} SELECT term, count(*) AS papers, count(*) FILTER (WHERE is_before) AS before, round(count(*) FILTER (WHERE is_before) / count(*), 4) AS share FROM x GROUP BY term HAVING count(*) > 5")
def term_profile(t: Tables) -> DataFrame:
    return postings(t).groupBy("term").agg(F.count("*").alias("papers"), F.count_if("is_before").alias("before"), rate(F.count_if("is_before"), F.count("*")).alias("share")).where("papers > 5")


RECORDS = """rec AS (SELECT doc_id AS rec, source, CAST(doc_id % 7 AS INT) AS src_rank, CASE WHEN doc_id % 4 = 0 THEN 'd' || (doc_id % 90) END AS doi, nullif(left(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 110), '') AS title_key, left(text, 30) AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS citations, CASE WHEN doc_id % 5 > 0 THEN CAST(2000 + doc_id % 20 AS INT) END AS year FROM documents)"""
MERGED = f"""WITH RECURSIVE {RECORDS}, tk AS (SELECT title_key FROM rec WHERE title_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doi) <= 1),
ky AS (SELECT rec, 'd' || doi AS k FROM rec WHERE doi IS NOT NULL UNION ALL SELECT rec, 't' || title_key FROM rec WHERE title_key IN (SELECT title_key FROM tk)), ed AS (SELECT DISTINCT a.rec AS a, b.rec AS b FROM ky a JOIN ky b USING (k) WHERE a.rec <> b.rec),
rc AS (SELECT rec AS node, rec AS root FROM rec UNION SELECT ed.b, rc.root FROM rc JOIN ed ON ed.a = rc.node), cm AS (SELECT node, min(root) AS work FROM rc GROUP BY node), al AS (SELECT * FROM rec JOIN cm ON node = rec),
mg AS (SELECT work, first(source ORDER BY src_rank, source, rec) AS source, min(src_rank) AS rank, first(doi ORDER BY src_rank, source, rec) FILTER (WHERE doi IS NOT NULL) AS doi, first(title ORDER BY src_rank, source, rec) FILTER (WHERE title IS NOT NULL) AS title, first(year ORDER BY src_rank, source, rec) FILTER (WHERE year IS NOT NULL) AS year_, max(coalesce(citations, 0)) AS citations, array_to_string(list_sort(list(DISTINCT source)), ',') AS also_in, count(*) AS n_records FROM al GROUP BY work)"""


def merged(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    rec = t.documents.select(i.alias("rec"), "source", (i % 7).cast("int").alias("src_rank"), F.when(i % 4 == 0, F.concat(F.lit("d"), (i % 90).cast("string"))).alias("doi"), tx.squashed(F.col("text")).alias("title_key"), F.left("text", F.lit(30)).alias("title"), F.when(i % 3 != 0, F.col("n_chars")).alias("citations"), F.when(i % 5 > 0, (2000 + i % 20).cast("int")).alias("year"))
    return corpus.merged(rec)


@query(f"{MERGED} SELECT * EXCLUDE (year_), coalesce(year_, 0) AS year FROM mg")
def merge_records(t: Tables) -> DataFrame:
    return merged(t).withColumn("also_in", F.array_join("also_in", ",")).fillna(0, ["year"])


@query(f"{MERGED} SELECT work, rank, row_number() OVER (ORDER BY rank, len(string_split(also_in, ',')) DESC, work) AS place FROM mg QUALIFY place <= 40")
def merge_relevance_sort(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    best = corpus.by_relevance(merged(t)).limit(40)
    return best.withColumn("place", F.row_number().over(Window.orderBy("rank", F.size("also_in").desc(), "work"))).select("work", "rank", "place")


@query("""WITH r(domain, source, ord) AS (VALUES ('en', 'a', 1), ('en', 'b', 2), ('de', 'c', 1), ('general', 'g', 1), ('general', 'h', 2)), d AS (SELECT DISTINCT lang AS domain FROM documents)
SELECT d.domain, r.source, r.ord FROM d JOIN r ON r.domain = d.domain UNION ALL SELECT d.domain, r.source, r.ord FROM d JOIN r ON r.domain = 'general' WHERE d.domain NOT IN (SELECT domain FROM r)""")
def source_routing(t: Tables) -> DataFrame:
    routing = t.spark.createDataFrame([("en", "a", 1), ("en", "b", 2), ("de", "c", 1), ("general", "g", 1), ("general", "h", 2)], "domain string, source string, ord int")
    return records.routed(t.documents.select(F.col("lang").alias("domain")).distinct(), routing)


@query("SELECT doc_id, lang, source FROM documents WHERE (n_chars IS NULL OR n_chars BETWEEN 500 AND 3000) AND lang IN ('en', 'fr') AND text ILIKE 'the%'")
def filtered_documents(t: Tables) -> DataFrame:
    return rel.where_all(t.documents, lang=["en", "fr"]).where(rel.in_years(F.col("n_chars"), 500, 3000) & F.expr("text ILIKE 'the%'")).select("doc_id", "lang", "source")
