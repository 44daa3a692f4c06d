"""The catalogue's queries as DuckDB SQL, for those that SQL can express."""

from __future__ import annotations

from quillion.functions.vocabulary import AUTO_CATEGORIES, BM25_STOP_WORDS, CLAIM_PATTERNS, COMMON_NUMBERS, EMBEDDING_CLAIM_PATTERNS, KEYWORD_STOP_WORDS, OVERLAP_STOP_WORDS, PROCESS_MARKERS, RERANK_VAGUE_WORDS, SAMPLE_THESAURUS, TAXONOMY
from quillion.operators import enrich, verify


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qs(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


NL = "chr(10)"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def fold(x: str) -> str:
    return squeeze(rf"regexp_replace(strip_accents(lower({x})), '\p{{Mn}}', '', 'g')")


def query_key(x: str) -> str:
    return squeeze(rf"regexp_replace({fold(x)}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


def tokens(x: str, longer: int, stop=()) -> str:
    keep = f"length(w) > {longer}" + (f" AND NOT list_contains({qs(stop)}, w)" if stop else "")
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: {keep})"


def spaced(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"CASE WHEN {squeeze(x)} = '' THEN 0 ELSE len(string_split({squeeze(x)}, ' ')) END"


def any_in(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def sentences(x: str) -> str:
    lines = rf"list_transform(string_split_regex({x}, '\r\n|\r|\n'), lambda s: {strip(chr(0)).replace(chr(0), chr(1))})".replace("\x01", r"regexp_replace(s, '^\s*[-*]\s*', '')")
    pieces = f"flatten(list_transform({lines}, lambda s: string_split_regex(s, '[.!?;]+')))"
    return f"list_filter(list_transform({pieces}, lambda s: {strip('s')}), lambda s: length(s) > 8)"


def windows(x: str) -> str:
    ss = sentences(x)
    made = f"list_filter(list_transform(range(1, len({ss}) + 1), lambda i: array_to_string(list_slice({ss}, i, i + 2), ' ')), lambda s: length(s) > 30)"
    return made


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


DOC_TOKENS = tokens("coalesce(text, '')", 2, BM25_STOP_WORDS)
DOC_SPACED = spaced("coalesce(text, '')")


def bm25(name: str, docs: str, questions: str, variant: str, k: int) -> str:
    """CTEs that end in ``name`` (q, rank, d, score); docs has (d, text), questions (q, text)."""
    cut = DOC_TOKENS if variant == "plus1" else DOC_SPACED
    idf = "ln((n - df + 0.5) / (df + 0.5) + 1)"
    if variant == "okapi":
        idf = "CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * avg(ln(n - df + 0.5) - ln(df + 0.5)) OVER () ELSE ln(n - df + 0.5) - ln(df + 0.5) END"
    return f"""
{name}_d AS (SELECT d, {cut} AS t FROM {docs}),
{name}_s AS (SELECT count(*) AS n, sum(len(t)) / greatest(count(*), 1) AS a FROM {name}_d),
{name}_tf AS (SELECT d, len(t) AS l, term, count(*) AS tf FROM (SELECT d, t, unnest(t) AS term FROM {name}_d) GROUP BY d, l, term),
{name}_df AS (SELECT term, df, {idf} AS idf FROM (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term), {name}_s),
{name}_q AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest({cut}) AS term FROM {questions}) GROUP BY q, term),
{name}_sc AS (SELECT q, d, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score
  FROM {name}_tf JOIN {name}_q USING (term) JOIN {name}_df USING (term), {name}_s GROUP BY q, d),
{name} AS (SELECT q, rank, d, score FROM (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, d))::INT AS rank FROM {name}_sc) WHERE rank <= {k})"""


DOCS_D = "docs AS (SELECT doc_id AS d, text FROM documents), asked AS (SELECT item_id AS q, text FROM benchmark)"
SIM = "greatest(0.35, 1 - (rank - 1) * 0.05)"
#: The corpus after the changes of the catalogue's ``_later``.
LATER = """later AS (SELECT doc_id AS d, CASE WHEN doc_id % 13 = 5 THEN 'what is new here: ' || text ELSE text END AS text FROM documents WHERE doc_id % 17 <> 3
  UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 11 = 1), asked AS (SELECT item_id AS q, text FROM benchmark)"""
VECTORS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, a.e AS qe, b.e AS ve FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
dist AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(qe, ve), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM p),
top AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM dist) WHERE rank <= 24)"""
RRF = f"""
one AS (SELECT q, d, rank, {SIM} AS s FROM okapi), two AS (SELECT q, d, rank, {SIM} AS s FROM plus),
merged AS (SELECT q, d, sum(0.5 / (60 + rank)) AS rrf, array_to_string(list_sort(list(DISTINCT src)), '+') AS retrieval_source,
  min(rank) FILTER (src = 'vector') AS vector_rank, min(rank) FILTER (src = 'bm25') AS bm25_rank,
  max(s) FILTER (src = 'vector') AS sv, max(s) FILTER (src = 'bm25') AS sl
  FROM (SELECT *, 'vector' AS src FROM one UNION ALL SELECT *, 'bm25' FROM two) GROUP BY q, d),
flagged AS (SELECT *, bool_or(bm25_rank IS NOT NULL) OVER (PARTITION BY q) AS lex FROM merged),
scored AS (SELECT q, d, CASE WHEN lex THEN round(rrf, 8) END AS rrf_score,
  round(CASE WHEN lex THEN greatest(coalesce(sv, sl, 0.5), 30 * rrf) ELSE coalesce(sv, sl, 0.5) END, 6) AS similarity_score, vector_rank, bm25_rank, retrieval_source FROM flagged),
fused AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY rrf_score DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, d))::INT AS rank FROM scored) WHERE rank <= 12)"""
RANKINGS = f"WITH {DOCS_D}, {bm25('okapi', 'docs', 'asked', 'okapi', 24)}, {bm25('plus', 'docs', 'asked', 'plus1', 18)}, {RRF}"

_NAME = fold("replace(replace(filename, '_', ' '), '.html', '')")
_DENSITY = "len(list_distinct(sw)) / greatest(len(sw), 1)"


def signals(low: str, text: str) -> str:
    procedure = any_in(low, ["étape", "procédure", "process", "comment"])
    months = "janvier|février|mars|avril|mai|juin|juillet|aoû?t|septembre|octobre|novembre|décembre"
    date = rf"(?i)(^|[^\p{{L}}\p{{N}}_])(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+({months}))($|[^\p{{L}}\p{{N}}_])"
    return f"((CASE WHEN contains({low}, 'whaller') THEN 1.0 ELSE 0.5 END + CASE WHEN {procedure} THEN 1.0 ELSE 0.5 END + CASE WHEN regexp_matches({text}, {q(date)}) THEN 1.0 ELSE 0.5 END + 0.5) / 4)"


CANDIDATES = f"""{RANKINGS},
c0 AS (SELECT q, f.d, f.rank AS arrival, similarity_score, t.text AS content, t.source || '_' || t.lang || '.html' AS filename, t.doc_id % 5 = 0 AS summary, b.text AS question,
  string_split(t.text, {NL})[1] AS title, {spaced('t.text')} AS sw, {signals('lower(t.text)', 't.text')} AS rel
  FROM fused f JOIN documents t ON t.doc_id = f.d JOIN benchmark b ON b.item_id = f.q),
c1 AS (SELECT *, {fold('question')} AS fq, {tokens('question', 3, KEYWORD_STOP_WORDS)} AS kw, {fold('content')} AS fc, {fold('title')} AS ft, {_NAME} AS fname, {_DENSITY} AS density FROM c0),
c2 AS (SELECT *, len(list_filter(kw, lambda w: contains(fc, w))) AS exact, len(list_filter(kw, lambda w: contains(fname, w))) AS nn,
  len(list_filter(kw, lambda w: contains(ft, strip_accents(w)))) AS mm, {any_in('fq', TAXONOMY['broad'])} AS broad, {any_in('fq', TAXONOMY['specific'])} AS specific,
  CASE WHEN len(kw) = 0 THEN 0.0 ELSE least(len(list_filter(kw, lambda w: contains(lower(content), w))) / len(kw), 1.0) END AS cover FROM c1),
m1 AS (SELECT *, CASE WHEN nn >= 2 THEN 0.9 WHEN nn = 1 THEN 0.7 ELSE 0.5 END AS s1 FROM c2),
m2 AS (SELECT *, CASE WHEN summary THEN greatest(s1, CASE WHEN contains(fq, 'comment') OR contains(fq, 'quoi') THEN 0.8 ELSE 0.4 END) ELSE s1 END AS s2 FROM m1),
m3 AS (SELECT *, CASE WHEN summary AND broad AND NOT specific THEN greatest(s2, 0.85) WHEN summary AND specific THEN least(s2, 0.35) ELSE s2 END AS s3 FROM m2),
m4 AS (SELECT *, (CASE WHEN mm > 0 THEN least(1.0, s3 + least(mm * 0.08, 0.20)) ELSE s3 END) * 0.85 + rel * 0.15 AS s4 FROM m3),
m5 AS (SELECT *, CASE WHEN density < 0.18 THEN s4 * 0.9 WHEN density > 0.45 THEN least(1.0, s4 + 0.05) ELSE s4 END AS s5 FROM m4),
m6 AS (SELECT *, least(CASE WHEN length(content) < 200 AND contains(lower(content), 'whaller') THEN s5 * 0.6 ELSE s5 END, 1.0) AS metadata_score FROM m5),
cand AS (SELECT *, CASE
  WHEN length({strip('content')}) < 150 AND contains(fc, 'consulter') AND contains(fc, 'whaller') AND similarity_score > 0.30 THEN 0.60
  WHEN length({strip('content')}) < 150 THEN 0.15 WHEN similarity_score < 0.30 AND exact < 2 THEN 0.10
  ELSE least(similarity_score, 1.0) * 0.50 + least(length(content) / 4000.0, 1.0) * 0.12 + least(greatest(len(string_split_regex(content, '[.!?]')), 1) / 15.0, 1.0) * 0.08
    + (CASE WHEN exact >= 2 THEN least(cover * 1.5, 1.0) ELSE cover END) * 0.20 + metadata_score * 0.10 END AS rerank_score FROM m6)"""


def kept(score: str, first: str, again: str | None, least: int) -> str:
    return f""",
r1 AS (SELECT q, d, arrival, round({score}, 6) AS score, fq FROM cand),
r2 AS (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, arrival))::INT AS rank, {first} AS ok1, {again or first} AS ok2 FROM r1),
r3 AS (SELECT *, count(*) FILTER (ok1) OVER (PARTITION BY q) AS n1, count(*) FILTER (ok2) OVER (PARTITION BY q) AS n2 FROM r2)
SELECT q AS item_id, rank, d AS doc_id, score AS rerank_score FROM r3 WHERE rank <= 6 AND CASE WHEN n1 >= {least} THEN ok1 WHEN n2 >= 1 THEN ok2 ELSE rank = 1 END"""


_VAGUE = any_in("fq", RERANK_VAGUE_WORDS + TAXONOMY["broad"])
USERS = "(SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')"
MARKED = f"(SELECT doc_id, replace(text, {NL}, {NL} || '+-') AS text FROM documents)"
_STEM = r"regexp_extract(t, '([\p{L}\p{N}_]+)$', 1)"


def thesaurus() -> str:
    return "(VALUES " + ", ".join(f"({q(t)}, {q(a)})" for t, alts in SAMPLE_THESAURUS.items() for a in alts) + ") AS th(term, alternative)"


def steps(x: str, table, at: int) -> str:
    out = "CASE " + " ".join(f"WHEN {x} < {s[0]} THEN {q(s[at]) if isinstance(s[at], str) else s[at]}" for s in table if s[0] is not None)
    last = table[-1][at]
    return f"{out} ELSE {q(last) if isinstance(last, str) else last} END"


SYNONYMS = f"""syn AS (SELECT item_id, replace(lower(text), term, alternative) AS v FROM benchmark, {thesaurus()} WHERE contains(lower(text), term)),
both_syn AS (SELECT DISTINCT item_id, unnest([v, upper(left(v, 1)) || lower(substr(v, 2))]) AS variant FROM syn)"""


def plurals(source: str) -> str:
    return f"""SELECT DISTINCT item_id, replace(t, w, w || 's') AS variant FROM (SELECT item_id, t, {_STEM} AS w FROM (SELECT item_id, lower({source}) AS t FROM benchmark)) WHERE w <> '' AND length(w || 's') > 3"""


ANSWERS = """answers AS (SELECT a.conv_id::VARCHAR || '-' || a.turn::VARCHAR AS answer_id, a.text AS response, b.text AS source
  FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn WHERE a.role = 'assistant')"""
_CLAIM_ANY = " OR ".join(f"regexp_matches(lower(s), {q(p)})" for p in CLAIM_PATTERNS)
CLAIM_LIST = f"""ss AS (SELECT *, {sentences("coalesce(response, '')")} AS sents FROM answers),
cl AS (SELECT *, list_filter(sents, lambda s: {_CLAIM_ANY}) AS good FROM ss),
cs AS (SELECT *, CASE WHEN len(good) > 0 THEN good ELSE sents END AS cc FROM cl)"""


def sensitive(x: str) -> str:
    masked = f"regexp_replace({x}, {q(verify.BEYOND_ASCII)}, '_', 'g')"
    every = "flatten([" + ", ".join(f"regexp_extract_all({masked}, {q(p)})" for p in verify.SENSITIVE) + "])"
    cited = f"list_transform(regexp_extract_all({x}, {q(verify.CITATION)}, 1), lambda c: upper(c))"
    keep = f"NOT list_contains({cited}, upper(t)) AND NOT (regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '[0-9]') AND upper(t) <> t) AND NOT list_contains({qs(COMMON_NUMBERS)}, t)"
    return f"list_filter({every}, lambda t: {keep})"


VERDICTS = f"""WITH {ANSWERS}, {CLAIM_LIST},
c AS (SELECT answer_id, source, (i - 1)::INT AS claim_no, cc[i] AS claim FROM (SELECT answer_id, source, cc, unnest(range(1, len(cc) + 1)) AS i FROM cs WHERE source IS NOT NULL AND {strip('source')} <> '')),
cited AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(claim, {q(verify.CITATION)}, 1), lambda x: upper(x)))) AS ids FROM c),
ev AS (SELECT *, CASE WHEN list_contains(ids, 'S1') THEN {strip('source')} ELSE '' END AS ct FROM cited),
ev2 AS (SELECT *, CASE WHEN ct <> '' THEN ct ELSE source END AS evidence, {sensitive('claim')} AS tok FROM ev),
ev3 AS (SELECT *, list_filter(tok, lambda t, i: list_position(tok, t) = i AND NOT contains(lower(evidence), lower(t)))[1:5] AS missing FROM ev2),
f AS (SELECT *, len(ids) > 0 AS has, CASE WHEN ct <> '' THEN array_to_string(ids, '+') ELSE '' END AS ek,
  CASE WHEN contains(lower(source), lower(claim)) THEN CASE WHEN len(ids) > 0 THEN 'supported' ELSE 'unclear:citation manquante' END
       WHEN len(ids) > 0 AND ct = '' THEN 'hallucinated:citation inconnue'
       WHEN len(missing) > 0 THEN 'hallucinated:tokens absents: ' || array_to_string(missing, ', ') END AS first FROM ev3),
o AS (SELECT * FROM f WHERE first IS NULL),
es AS (SELECT *, {sentences('evidence')} AS es FROM (SELECT DISTINCT answer_id, ek, evidence FROM o)),
wl AS (SELECT answer_id, ek, evidence, list_filter(list_transform(range(1, len(es) + 1), lambda i: array_to_string(list_slice(es, i, i + 2), ' ')), lambda s: length(s) > 30) AS ws FROM es),
w AS (SELECT answer_id, ek, i AS window_no, wz[i] AS win FROM (SELECT answer_id, ek, wz, unnest(range(1, len(wz) + 1)) AS i FROM (SELECT answer_id, ek, CASE WHEN len(ws) > 0 THEN ws ELSE [evidence] END AS wz FROM wl))),
wt AS (SELECT answer_id, ek, window_no, len(t) + 1 AS total, unnest(t) AS term FROM (SELECT *, {tokens('win', 2)} AS t FROM w)),
wtf AS (SELECT answer_id, ek, window_no, total, term, count(*) AS tf FROM wt GROUP BY ALL),
wn AS (SELECT answer_id, ek, count(*) AS n FROM w GROUP BY ALL),
idf AS (SELECT answer_id, ek, term, ln(any_value(n) / (count(*) + 1)) AS idf FROM wtf JOIN wn USING (answer_id, ek) GROUP BY ALL),
rv AS (SELECT answer_id, ek, window_no, term, tf / total * idf AS wv FROM wtf JOIN idf USING (answer_id, ek, term)),
ctf AS (SELECT answer_id, ek, claim_no, total, term, count(*) AS tf FROM (SELECT answer_id, ek, claim_no, len(t) + 1 AS total, unnest(t) AS term FROM (SELECT *, {tokens('claim', 2)} AS t FROM o)) GROUP BY ALL),
lv AS (SELECT answer_id, ek, claim_no, term, tf / total * idf AS cv FROM ctf JOIN idf USING (answer_id, ek, term)),
rn AS (SELECT answer_id, ek, window_no, sqrt(sum(wv * wv)) AS rn FROM rv GROUP BY ALL), ln_ AS (SELECT answer_id, ek, claim_no, sqrt(sum(cv * cv)) AS cn FROM lv GROUP BY ALL),
dots AS (SELECT answer_id, ek, claim_no, window_no, sum(cv * wv) AS dot FROM lv JOIN rv USING (answer_id, ek, term) GROUP BY ALL),
tf_best AS (SELECT answer_id, ek, claim_no, greatest(max(CASE WHEN cn > 0 AND rn > 0 THEN dot / (cn * rn) ELSE 0 END), 0) AS t FROM dots JOIN rn USING (answer_id, ek, window_no) JOIN ln_ USING (answer_id, ek, claim_no) GROUP BY ALL),
ow AS (SELECT answer_id, ek, list_distinct({tokens('win', 3, OVERLAP_STOP_WORDS)}) AS b FROM w),
oc AS (SELECT answer_id, ek, claim_no, list_distinct({tokens('claim', 3, OVERLAP_STOP_WORDS)}) AS a FROM o),
o_best AS (SELECT answer_id, ek, claim_no, max(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) END) AS ov FROM oc JOIN ow USING (answer_id, ek) GROUP BY ALL),
fin AS (SELECT f.answer_id, f.claim_no, f.claim, f.first, f.has, CASE WHEN first IS NULL THEN round(coalesce(t, 0.0), 6) END AS best_tfidf, CASE WHEN first IS NULL THEN round(coalesce(ov, 0.0), 6) END AS best_overlap
  FROM f LEFT JOIN tf_best USING (answer_id, ek, claim_no) LEFT JOIN o_best USING (answer_id, ek, claim_no)),
full_ AS (SELECT *, coalesce(first, CASE WHEN best_tfidf > 0.18 OR best_overlap > 0.35 THEN CASE WHEN has THEN 'supported' ELSE 'unclear:citation manquante' END WHEN best_tfidf < 0.08 AND best_overlap < 0.15 THEN 'hallucinated' ELSE 'unclear' END) AS v FROM fin),
verdict AS (SELECT answer_id, claim_no, split_part(v, ':', 1) AS verdict, regexp_extract(v, '^[^:]*:(.*)$', 1) AS reason, best_tfidf, best_overlap FROM full_)"""

CACHE = f"""rows_ AS (SELECT md5('{{"namespace": "model=m|embed=e|corpus=c", "query": "' || {query_key('text')} || '"}}') AS query_hash, conv_id * 60.0::DOUBLE + turn AS timestamp, conv_id * 1000 + turn AS entry_id FROM {USERS})"""


def latest(source: str) -> str:
    return f"SELECT query_hash, timestamp, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY timestamp DESC, entry_id DESC) AS n FROM {source}) WHERE n = 1"


def escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def unescape(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def preview(x: str) -> str:
    return f"CASE WHEN length({x}) > 200 THEN left({x}, 200) || '...' ELSE {x} END"


_TITLES = r"list_transform(regexp_extract_all(text, '\+-([^\n]+)', 1), lambda s: " + strip("s") + ")"
_DOC_TITLE = f"coalesce(nullif({strip(chr(34) + 'dt' + chr(34))}, ''), 'Document')"
SECTIONS = rf"""sec AS (SELECT doc_id, text, regexp_extract(text, 'Titre du document : ([^\n]+)', 1) AS dt, {_TITLES} AS titles,
  string_split_regex(regexp_replace(text, '\+-([^\n])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM {MARKED})"""

#: The choice by marginal relevance, step by step: what was chosen is carried along as a list of vectors.
MMR = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, a.e AS qe, b.e AS ve FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
dist AS (SELECT *, round(list_sum(list_transform(list_zip(qe, ve), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM p),
cand AS (SELECT *, list_cosine_similarity(qe, ve) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS arrival FROM dist) WHERE arrival <= 30),
sel AS (
  SELECT DISTINCT query_id, 0 AS step, -1::BIGINT AS vec_id, []::BIGINT[] AS ids, []::DOUBLE[][] AS es FROM cand
  UNION ALL
  SELECT query_id, step + 1, vec_id, list_append(ids, vec_id), list_append(es, ve) FROM (
    SELECT s.query_id, s.step, c.vec_id, s.ids, s.es, c.ve, row_number() OVER (PARTITION BY s.query_id ORDER BY
      CASE WHEN s.step = 0 THEN c.rel ELSE 0.5 * c.rel - 0.5 * list_max(list_transform(s.es, lambda e: list_cosine_similarity(e, c.ve))) END DESC, c.arrival) AS n
    FROM sel s JOIN cand c USING (query_id) WHERE s.step < 20 AND NOT list_contains(s.ids, c.vec_id)) WHERE n = 1)
SELECT query_id, step::INT AS rank, vec_id FROM sel WHERE step > 0"""
#: The budget is shared out document by document, in the order of rank.
_CUT = "CASE WHEN length(text) > lim THEN CASE WHEN dot > lim * 0.7 THEN left(head, dot + 1) ELSE head END || '...' ELSE text END"
PACK = f"""WITH RECURSIVE {DOCS_D}, {bm25('r', 'docs', 'asked', 'plus1', 6)},
g AS (SELECT q, d, rank, count(*) OVER (PARTITION BY q) AS n, coalesce(t.text, '') AS text FROM r JOIN documents t ON t.doc_id = r.d),
f AS (
  SELECT DISTINCT q, 0::BIGINT AS rank, 0::BIGINT AS d, 0::BIGINT AS total, '' AS packed FROM g
  UNION ALL
  SELECT q, rank, d, total + length(packed), packed FROM (SELECT q, rank, d, total, {_CUT} AS packed FROM (
    SELECT *, CASE WHEN contains(head, '.') THEN length(head) - position('.' IN reverse(head)) ELSE -1 END AS dot FROM (
      SELECT *, left(text, lim) AS head FROM (
        SELECT g.q, g.rank, g.d, f.total, g.text, greatest(1000, (3000 - f.total) // greatest(g.n - g.rank + 1, 1))::BIGINT AS lim FROM f JOIN g ON g.q = f.q AND g.rank = f.rank + 1)))))
SELECT q AS item_id, rank::INT AS position, d AS doc_id, length(packed)::INT AS n_chars, md5(packed) AS text_md5 FROM f WHERE rank > 0"""
_EMBEDDING_ANY = " OR ".join(f"regexp_matches(lower(s), {q(p)})" for p in EMBEDDING_CLAIM_PATTERNS)
_PLAIN = f"list_filter(list_transform(string_split_regex(coalesce(response, ''), '[.!?]+'), lambda s: {strip('s')}), lambda s: length(s) > 15)"
EMBEDDING_CLAIMS = f"""WITH {ANSWERS}, ss AS (SELECT answer_id, {_PLAIN} AS sents FROM answers),
cl AS (SELECT *, list_filter(sents, lambda s: {_EMBEDDING_ANY}) AS good FROM ss), cs AS (SELECT answer_id, CASE WHEN len(good) > 0 THEN good ELSE sents END AS cc FROM cl)
SELECT answer_id, (i - 1)::INT AS claim_no, cc[i] AS claim FROM (SELECT answer_id, cc, unnest(range(1, len(cc) + 1)) AS i FROM cs)"""
_HYBRID = RRF.replace(f"one AS (SELECT q, d, rank, {SIM} AS s FROM okapi)", "one AS (SELECT query_id // 100 AS q, vec_id AS d, rank, round(1 / (1 + greatest(distance, 0.0)), 6) AS s FROM top)")

SQL = {
    "mmr_topk": MMR,
    "context_pack": PACK,
    "embedding_claims": EMBEDDING_CLAIMS,
    "hybrid_fusion": f"WITH {DOCS_D}, {VECTORS}, {bm25('plus', 'docs', 'asked', 'plus1', 18)}, {_HYBRID} SELECT q AS item_id, d AS doc_id, rank, rrf_score, similarity_score, vector_rank, bm25_rank, retrieval_source FROM fused",
    "text_fold": f"SELECT doc_id, md5({fold('t')}) AS folded_md5, md5({query_key('t')}) AS key_md5, ({word_count('t')})::BIGINT AS n_words FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "term_frequencies": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text', 2, BM25_STOP_WORDS)}) AS term FROM documents) GROUP BY doc_id, term",
    "document_frequencies": f"WITH t AS (SELECT DISTINCT doc_id, unnest({tokens('text', 2, BM25_STOP_WORDS)}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln(any_value(n) / (count(*) + 1)), 6) AS idf_tfidf, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf_bm25 FROM t, n GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n_docs, sum(len({tokens('text', 2, BM25_STOP_WORDS)}))::BIGINT AS n_tokens, round(sum(len({tokens('text', 2, BM25_STOP_WORDS)})) / greatest(count(*), 1), 6) AS avg_length FROM documents",
    "bm25_topk": f"WITH {DOCS_D}, {bm25('r', 'docs', 'asked', 'plus1', 18)} SELECT q AS item_id, rank, d AS doc_id, score, round({SIM}, 6)::DOUBLE AS similarity_score FROM r",
    "bm25_okapi_topk": f"WITH {DOCS_D}, {bm25('r', 'docs', 'asked', 'okapi', 18)} SELECT q AS item_id, rank, d AS doc_id, score, round({SIM}, 6)::DOUBLE AS similarity_score FROM r",
    "index_delta_frequencies": f"WITH {LATER}, t AS (SELECT DISTINCT d, unnest({DOC_TOKENS}) AS term FROM later) SELECT term, count(*) AS df FROM t GROUP BY term",
    "index_delta_topk": f"WITH {LATER}, {bm25('r', 'later', 'asked', 'plus1', 18)} SELECT q AS item_id, rank, d AS doc_id, score FROM r",
    "vector_topk": f"WITH {VECTORS} SELECT query_id, rank, vec_id, distance, round(1 / (1 + greatest(distance, 0.0)), 6) AS similarity_score, round({SIM}, 6)::DOUBLE AS rank_score FROM top",
    "vector_cosine": f"WITH {VECTORS} SELECT query_id, vec_id, round(list_cosine_similarity(qe, ve), 6) AS cosine FROM p",
    "similarity_threshold": f"WITH {VECTORS} SELECT query_id, rank, vec_id, round(1 / (1 + greatest(distance, 0.0)), 6) AS similarity_score FROM top WHERE round(1 / (1 + greatest(distance, 0.0)), 6) >= 0.4",
    "rrf_fusion": f"{RANKINGS} SELECT q AS item_id, d AS doc_id, rank, rrf_score, similarity_score, vector_rank, bm25_rank, retrieval_source FROM fused",
    "multi_query_dedupe": f"""WITH docs AS (SELECT doc_id AS d, text FROM documents), w AS (SELECT item_id, {spaced("coalesce(text, '')")} AS w FROM benchmark),
asked AS (SELECT item_id * 10 + i AS q, CASE i WHEN 0 THEN array_to_string(w, ' ') WHEN 1 THEN array_to_string(w[1:len(w) // 2], ' ') ELSE array_to_string(w[len(w) // 2 + 1:], ' ') END AS text FROM w, range(3) AS r(i)),
{bm25('r', 'docs', 'asked', 'plus1', 18)},
x AS (SELECT q // 10 AS item_id, q % 10 AS variant_no, d AS doc_id, rank FROM r),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY variant_no, rank) AS n FROM x) WHERE n = 1)
SELECT item_id, doc_id, variant_no, rank, (row_number() OVER (PARTITION BY item_id ORDER BY variant_no, rank, doc_id))::INT AS arrival FROM y""",
    "rerank_score": f"{CANDIDATES} SELECT q AS item_id, d AS doc_id, round(metadata_score, 6) AS metadata_score, round(rerank_score + 1e-9, 6) AS rerank_score FROM cand",
    "rerank_topk": CANDIDATES + kept("rerank_score", f"score > CASE WHEN {_VAGUE} THEN 0.32 ELSE 0.38 END", f"score > CASE WHEN {_VAGUE} THEN 0.28 ELSE 0.32 END", 2),
    "rerank_cross": CANDIDATES + kept("greatest(0.0, least(greatest(0.0, least((cover * 20 - 10 + 10) / 20, 1.0)) + (CASE WHEN nn >= 2 THEN 0.10 WHEN nn = 1 THEN 0.05 ELSE 0.0 END) - (CASE WHEN length(content) < 200 THEN 0.15 ELSE 0.0 END), 1.0))", "score > 0.25", None, 1),
    "keyword_match": "SELECT conv_id, turn, " + ", ".join(f"{any_in('f', ws)} AS {name}" for name, ws in TAXONOMY.items()) + f" FROM (SELECT conv_id, turn, {fold('text')} AS f FROM {USERS})",
    "dynamic_topk": f"SELECT conv_id, turn, least(CASE WHEN specific AND NOT broad THEN 4 WHEN broad THEN 8 ELSE 6 END, 8)::INT AS k FROM (SELECT conv_id, turn, {any_in('f', TAXONOMY['specific'])} AS specific, {any_in('f', TAXONOMY['broad'])} OR n > 12 AS broad FROM (SELECT conv_id, turn, {fold('text')} AS f, {word_count('text')} AS n FROM {USERS}))",
    "route_expansion": f"SELECT conv_id, turn, (CASE WHEN {any_in('f', TAXONOMY['specific'])} OR (n <= 10 AND {any_in('f', ['comment', 'quoi'])}) THEN 0 WHEN {any_in('f', TAXONOMY['vague'])} THEN 2 ELSE 1 END)::INT AS expansion FROM (SELECT conv_id, turn, {fold('text')} AS f, {word_count('text')} AS n FROM {USERS})",
    "request_validation": f"SELECT conv_id, turn, CASE WHEN {strip('text')} = '' THEN 'empty' WHEN length(text) > 1000 THEN 'too long' ELSE '' END AS error FROM {USERS}",
    "synonym_expand": f"WITH {SYNONYMS} SELECT * FROM both_syn",
    "plural_expand": plurals(r"regexp_replace(text, '[.?!\s]+$', '')"),
    "query_variants": f"WITH {SYNONYMS}, every AS (SELECT item_id, text AS variant FROM benchmark UNION SELECT * FROM both_syn UNION {plurals('text')}) SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY variant COLLATE BINARY))::INT AS variant_no, variant FROM every WHERE variant IS NOT NULL".replace(" COLLATE BINARY", ""),
    "chunk_config": f"SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN floor(s * 0.85) ELSE s END)::INT AS chunk_size, (CASE WHEN doc_id % 2 = 0 THEN floor(o * 0.85) ELSE o END)::INT AS chunk_overlap FROM (SELECT doc_id, {steps('length(text)', enrich.CHUNKS, 1)} AS s, {steps('length(text)', enrich.CHUNKS, 2)} AS o FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))",
    "size_category": f"SELECT CASE WHEN grouping(c) = 1 THEN 'TOTAL' ELSE c END AS category, count(*) AS n FROM (SELECT {steps('length(text)', enrich.SIZES, 1)} AS c FROM documents) GROUP BY ROLLUP (c)",
    "section_split": rf"""WITH {SECTIONS} SELECT doc_id, i::INT AS section_num, len(titles)::INT AS total_sections, titles[i] AS section_title, CASE WHEN i > 1 THEN titles[i - 1] ELSE '' END AS prev_section_title,
coalesce(titles[i + 1], '') AS next_section_title, md5(titles[i] || chr(10) || chr(10) || {strip("regexp_replace(parts[i + 1], '^[^\n]*\n?', '')")}) AS content_md5 FROM (SELECT *, unnest(range(1, len(titles) + 1)) AS i FROM sec WHERE len(titles) > 0)""",
    "section_summaries": rf"""WITH {SECTIONS}, s AS (SELECT doc_id, titles, {_DOC_TITLE} AS title, {strip("regexp_replace(" + strip("parts[1]") + r", 'Titre du document : ([^\n]+)\n?', '', 'g')")} AS intro FROM sec WHERE len(titles) > 0)
SELECT doc_id, 0::INT AS section_num, len(titles)::INT AS total_sections, md5('Document: ' || title || chr(10) || chr(10) || 'Sommaire:' || chr(10) || CASE WHEN length(intro) > 50 THEN chr(10) || 'Introduction :' || chr(10) || left(intro, 400) || chr(10) ELSE '' END || chr(10) || 'Sections :' || chr(10)
|| array_to_string(list_transform(titles, lambda t, i: '  ' || i::VARCHAR || '. ' || t), chr(10))) AS content_md5 FROM s""",
    "doc_type": rf"""SELECT doc_id, CASE WHEN {any_in('text', ['Apache', 'MIT'])} THEN 'amadeus' WHEN {any_in('text', PROCESS_MARKERS)} THEN 'process' ELSE 'structured' END AS doc_type, {_DOC_TITLE} AS doc_title FROM (SELECT doc_id, text, regexp_extract(text, 'Titre du document : ([^\n]+)', 1) AS dt FROM documents)""",
    "enrich_documents": f"""SELECT doc_id, round({signals('low', 'text')}, 6)::DOUBLE AS reliability_score, array_to_string(list_filter([{', '.join(f"CASE WHEN {any_in('low', ws)} THEN {q(n)} END" for n, ws in AUTO_CATEGORIES.items())}], lambda x: x IS NOT NULL), ' ') AS category_string,
round({_DENSITY}, 6) AS information_density, length(text) / 1024 AS chunk_size_kb FROM (SELECT doc_id, text, lower(text) AS low, {spaced('text')} AS sw FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""",
    "freshness": "SELECT o_orderkey, (CASE WHEN days < 365 THEN 1.0 WHEN days < 1095 THEN 0.8 WHEN days < 1825 THEN 0.6 WHEN days < 2920 THEN 0.4 ELSE 0.3 END)::DOUBLE AS freshness FROM (SELECT o_orderkey, floor((epoch(TIMESTAMP '2025-01-01') - epoch(o_orderdate)) / 86400) AS days FROM orders)",
    "stable_ids": "SELECT doc_id, md5(source || '.html|' || p || '|parent') AS parent_id, CASE WHEN doc_id % 2 = 1 THEN md5(source || '.html|' || p || '|full') ELSE md5(source || '.html|' || p || '|' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE (doc_id % 7)::VARCHAR END || '|' || lang) END AS child_id FROM (SELECT *, CASE WHEN doc_id = 0 THEN '' ELSE doc_id::VARCHAR END AS p FROM documents)",
    "doc_key": f"SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN source || '|' || doc_id::VARCHAR || '|' || lang || '|' ELSE md5({squeeze('lower(text)')}) END AS doc_key FROM documents",
    "html_title": "SELECT page_id, " + unescape(r"trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1))") + " AS title FROM pages",
    "sample_document": f"SELECT doc_id, {preview('text')} AS preview FROM documents WHERE contains(lower(text), 'apache') OR contains(lower(text), 'repas') ORDER BY doc_id LIMIT 1",
    "sentences": f"SELECT conv_id, turn, (i - 1)::INT AS sentence_no, ss[i] AS sentence FROM (SELECT conv_id, turn, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT conv_id, turn, {sentences(chr(34) + 'text' + chr(34))} AS ss FROM conversations))",
    "claims": f"WITH {ANSWERS}, {CLAIM_LIST} SELECT answer_id, (i - 1)::INT AS claim_no, cc[i] AS claim FROM (SELECT answer_id, cc, unnest(range(1, len(cc) + 1)) AS i FROM cs)",
    "sensitive_tokens": f"SELECT doc_id, array_to_string(list_filter(t, lambda v, i: list_position(t, v) = i), '|') AS tokens FROM (SELECT doc_id, {sensitive('text')} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))",
    "citations": f"SELECT conv_id, turn, (i - 1)::INT AS n, CASE WHEN (i - 1) % 4 = 0 THEN 'S' || (i - 1)::VARCHAR ELSE '' END AS cited FROM (SELECT conv_id, turn, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT conv_id, turn, {sentences(chr(34) + 'text' + chr(34))} AS ss FROM conversations))",
    "sentence_windows": f"WITH s AS (SELECT conv_id, turn, text, {sentences(chr(34) + 'text' + chr(34))} AS ss FROM conversations), w AS (SELECT conv_id, turn, text, list_filter(list_transform(range(1, len(ss) + 1), lambda i: array_to_string(list_slice(ss, i, i + 2), ' ')), lambda x: length(x) > 30) AS ws FROM s), z AS (SELECT conv_id, turn, CASE WHEN len(ws) > 0 THEN ws ELSE [text] END AS ws FROM w) SELECT conv_id, turn, (i - 1)::INT AS window_no, ws[i] AS \"window\" FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM z)",
    "claim_verdicts": f"{VERDICTS} SELECT * FROM verdict",
    "long_evidence_overlap": f"""WITH d AS (SELECT doc_id, doc_id // 4 AS shelf, {sentences("coalesce(text, '')")} AS ss FROM documents),
c AS (SELECT doc_id, shelf - 1 AS shelf, (i - 1)::INT AS sentence_no, list_distinct({tokens('s', 3, OVERLAP_STOP_WORDS)}) AS a FROM (SELECT *, ss[i] AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM d))),
w AS (SELECT shelf, list_distinct({tokens('win', 3, OVERLAP_STOP_WORDS)}) AS b FROM (SELECT shelf, array_to_string(list_slice(ss, i, i + 2), ' ') AS win FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM d)) WHERE length(win) > 30)
SELECT doc_id, sentence_no, round(max(CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) END), 6) AS best_overlap, count(*) AS n_windows FROM c JOIN w USING (shelf) GROUP BY doc_id, sentence_no""",
    "answer_confidence": f"""{VERDICTS}, n AS (SELECT answer_id, count(*) AS n, count(*) FILTER (verdict = 'supported') AS s, count(*) FILTER (verdict = 'unclear') AS u, count(*) FILTER (verdict = 'hallucinated') AS h FROM verdict GROUP BY 1),
a AS (SELECT answer_id, source IS NULL AS none, source IS NOT NULL AND {strip('source')} = '' AS blank, len(cc) AS total FROM cs),
j AS (SELECT a.*, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(u, 0) AS u, coalesce(h, 0) AS h FROM a LEFT JOIN n USING (answer_id)),
v AS (SELECT *, round(CASE WHEN none THEN 1.0 WHEN blank THEN 0.5 WHEN n = 0 THEN 1.0 ELSE greatest(0.0::DOUBLE, 1 - (h + u * 0.35::DOUBLE) / greatest(n, 1)) END, 6)::DOUBLE AS confidence FROM j)
SELECT answer_id, n AS n_claims, s AS supported, CASE WHEN blank THEN total ELSE u END AS unclear, h AS hallucinated, confidence, CASE WHEN none THEN 'no sources' WHEN blank THEN 'no source text' ELSE '' END AS reason,
CASE WHEN confidence < 0.25 THEN 'REJECT' WHEN confidence < 0.5 THEN 'WARN' ELSE 'ACCEPT' END AS action, CASE WHEN confidence > 0.85 AND h = 0 THEN 'high' WHEN confidence > 0.65 THEN 'medium' ELSE 'low' END AS badge FROM v""",
    "context_blocks": f"""SELECT doc_id, md5('<source id="S' || (doc_id % 8 + 1)::VARCHAR || '" title="' || {escape('source')} || '" category="' || {escape('lang')} || '" document="' || {escape('source')} || '"' || CASE WHEN doc_id % 3 <> 0 THEN ' position="' || (doc_id % 3)::VARCHAR || '/3"' ELSE '' END || '>' || chr(10) || {escape("coalesce(text, '')")} || chr(10) || '</source>') AS block_md5 FROM documents""",
    "source_projection": f"SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS source_url, CASE WHEN doc_id % 2 = 0 THEN lang ELSE replace(source || '_x', '_', ' ') END AS title, CASE WHEN doc_id % 5 > 0 THEN lang ELSE 'Unknown' END AS category, {preview('text')} AS content_preview FROM documents",
    "cache_upsert": f"WITH {CACHE} {latest('rows_')}",
    "cache_lookup": f"WITH {CACHE}, stored AS ({latest('(SELECT * FROM rows_ WHERE entry_id % 2 = 0)')}), now_ AS (SELECT max(timestamp) AS now FROM rows_) SELECT r.entry_id AS asked, r.query_hash, coalesce(NOT (now - s.timestamp > 6000.0), false) AS hit, s.entry_id FROM rows_ r CROSS JOIN now_ LEFT JOIN stored s ON s.query_hash = r.query_hash",
    "cache_sweep": f"WITH {CACHE}, l AS ({latest('rows_')}) SELECT l.* FROM l, (SELECT max(timestamp) AS now FROM l) WHERE NOT (now - timestamp > 6000.0)",
    "eval_summary": "SELECT role, count(*) AS n_questions, count(*) FILTER (length(text) > 200) AS n_success, count(*) - count(*) FILTER (length(text) > 200) AS n_error, round(100.0::DOUBLE * count(*) FILTER (length(text) > 200) / count(*), 6) AS success_pct, round(100.0::DOUBLE * (count(*) - count(*) FILTER (length(text) > 200)) / count(*), 6) AS error_pct, round(sum(length(text) / 100.0::DOUBLE), 6) AS total_seconds, round(sum(length(text) / 100.0::DOUBLE) / count(*), 6) AS mean_seconds FROM conversations GROUP BY role",
    "event_activity": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
#: Stored indexes give what the direct searches give.
SQL |= {"stored_bm25_topk": SQL["bm25_topk"], "stored_bm25_okapi_topk": SQL["bm25_okapi_topk"], "stored_vector_topk": SQL["vector_topk"]}
SQL |= {f"stored_{name}": SQL[name] for name in ("cache_upsert", "cache_lookup", "cache_sweep")}
SQL["keyword_match_many"] = SQL["keyword_match"]
_FREQUENT = "(SELECT term, reverse(term) AS alternative FROM (SELECT unnest(string_split(lower(text), ' ')) AS term FROM documents) WHERE regexp_full_match(term, '[a-z]{4,}') GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000)"
SQL["synonym_expand_many"] = f"WITH {SYNONYMS.replace(thesaurus(), _FREQUENT)} SELECT * FROM both_syn"
SQL["section_split_sql"] = SQL["section_split"]
