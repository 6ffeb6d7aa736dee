"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from .values import ACCENTED, CUE_WORDS, CUES, DEFAULT_LANGUAGE, LEAST_STEM, LEAST_WORD, PLAIN, STOPWORDS, SUFFIXES

SPACE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}]"
STATED = ["src3", "the that and onesen", "licensed under the apache license", "ertion blehe inan", "de la ciónue", "src1 to of"]


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '[a-z]+')"


def language(x: str) -> str:
    first = f"list_distinct(({words(f'lower({x})')})[1:{CUE_WORDS}])"
    scores = {k: f"len(list_intersect({first}, {listed(v)}))" for k, v in CUES.items()}
    best = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {best} = 0 THEN '{DEFAULT_LANGUAGE}' " + " ".join(f"WHEN {s} = {best} THEN '{k}'" for k, s in scores.items()) + " END"


def by_language(lang: str, make) -> str:
    return f"CASE {lang} " + " ".join(f"WHEN '{k}' THEN {make(k)}" for k in STOPWORDS) + f" ELSE {make(DEFAULT_LANGUAGE)} END"


def without_stopwords(found: str, lang: str) -> str:
    return by_language(lang, lambda k: f"list_filter({found}, lambda t: length(t) > 1 AND NOT list_contains({listed(STOPWORDS[k])}, t))")


def stem(t: str, k: str) -> str:
    rules = [
        f"WHEN ends_with({t}, '{s}') AND length({t}) >= {LEAST_STEM + len(s) - len(new)} THEN substring({t}, 1, length({t}) - {len(s)}) || '{new}'" for s, new in SUFFIXES[k]
    ]
    return f"CASE WHEN length({t}) < {LEAST_WORD} THEN {t} {' '.join(rules)} ELSE {t} END"


def terms(found: str, lang: str) -> str:
    return by_language(lang, lambda k: f"list_transform(list_filter({found}, lambda t: length(t) > 1 AND NOT list_contains({listed(STOPWORDS[k])}, t)), lambda t: {stem('t', k)})")


def md5_of(x: str) -> str:
    return f"md5(array_to_string({x}, ' '))"


TEXTS = f"SELECT doc_id, text, {language('text')} AS lang FROM documents"
SONGS = r"SELECT CAST(doc_id AS VARCHAR) AS id, regexp_extract(text, '^[^.\n]*') AS titulo, source AS artista, lang AS genero, text AS letra FROM documents"
STATED_TABLE = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(STATED)) + ") AS stated(query_id, q)"


def analysed(text: str) -> str:
    return f"SELECT id AS doc_id, t, {language('t')} AS lang FROM (SELECT id, {text} AS t FROM s)"


INDEX = f"""
WITH s AS ({SONGS}),
it AS ({analysed("concat_ws(' ', titulo, artista, letra, genero)")}),
st AS ({analysed("concat_ws(' ', titulo, artista, letra)")}),
postings AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({terms(tokens('t'), 'lang')}) AS term FROM it) GROUP BY ALL),
found AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({terms(tokens('t'), 'lang')}) AS term FROM st) GROUP BY ALL),
lens AS (SELECT doc_id, len({words('t')}) AS doc_len FROM st),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
n AS (SELECT count(*) AS n FROM s)"""


#: The language of every second song is known.
REBUILT = INDEX.replace("FROM it)", "FROM (SELECT doc_id, t, CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN 'es' ELSE lang END AS lang FROM it))")


def scores(stated: str) -> str:
    return f"""{INDEX},
asked AS (SELECT DISTINCT query_id, unnest({terms(tokens('q'), language('q'))}) AS term FROM {stated}),
idf AS (SELECT query_id, asked.term, ln((n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE) + 1) AS idf FROM asked LEFT JOIN df ON asked.term = df.term, n),
scores AS (
  SELECT query_id, found.doc_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / (SELECT avg(doc_len) FROM lens)))) AS bm25
  FROM found JOIN idf ON found.term = idf.term JOIN lens ON found.doc_id = lens.doc_id GROUP BY ALL
)"""


SCORES = scores(STATED_TABLE)
TOP = "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM scores) WHERE rank <= 10"


def surface(stated: str) -> str:
    return f"""SELECT query_id, id AS doc_id,
  len(list_intersect({words('q')}, {words('lower(titulo)')})) AS title_words, len(list_intersect({words('q')}, {words('lower(artista)')})) AS artist_words,
  contains(lower(titulo), q) AS in_title, contains(lower(artista), q) AS in_artist, lower(artista) = q AND {strip('artista')} <> '' AS is_artist,
  starts_with(lower(titulo), ({words('q')})[1]) AS starts FROM s, {stated}"""


SURFACE = surface(STATED_TABLE)
NGRAMS = r"""
WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, concat_ws(' ', nullif(regexp_extract(text, '^[^.\n]*'), ''), source, lang, text) AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(lower(t), '[\p{L}\p{N}\p{M}_]{2,}') AS w FROM s),
g AS (SELECT doc_id, unnest(w) AS ngram FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
c AS (SELECT doc_id, ngram, count(*) AS n FROM g GROUP BY ALL),
top AS (SELECT ngram, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ngram ORDER BY total DESC, ngram LIMIT 5000)"""
CRAWLED = f"""SELECT conv_id, turn, array_to_string(({words('text')})[1:2], ' ') AS titulo, role AS artista FROM conversations"""
KEYED = f"""WITH r AS (SELECT *, {strip('lower(titulo)')} AS kt, {strip('lower(artista)')} AS ka FROM ({CRAWLED})),
known AS (SELECT DISTINCT ON (kt, ka) * FROM r WHERE conv_id % 3 = 0 AND turn = 0 ORDER BY kt, ka, conv_id, turn),
firsts AS (SELECT DISTINCT ON (kt, ka) * FROM r WHERE kt <> '' AND ka <> '' ORDER BY kt, ka, conv_id, turn),
added AS (SELECT * FROM firsts WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.kt = firsts.kt AND k.ka = firsts.ka))"""
SONG_ID = f"substring(md5({strip('lower(titulo)')} || '|' || {strip('lower(artista)')}), 1, 16)"

def lexical(stated: str) -> str:
    return f"""{scores(stated)}, parts AS (
  SELECT x.*, coalesce(bm25, 0) AS lexical, 2.0::DOUBLE * title_words + 2.0::DOUBLE * artist_words + 1.5::DOUBLE * coalesce(bm25, 0)
    + CASE WHEN in_title OR in_artist THEN 8.0 ELSE 0.0 END + CASE WHEN is_artist THEN 5.0 ELSE 0.0 END + CASE WHEN starts THEN 3.0 ELSE 0.0 END AS score
  FROM ({surface(stated)}) x LEFT JOIN scores ON x.query_id = scores.query_id AND x.doc_id = scores.doc_id
), results AS (
  SELECT parts.query_id, doc_id, q, score, [r for r in [
    CASE WHEN title_words > 0 THEN title_words || ' palabras en título' END, CASE WHEN artist_words > 0 THEN artist_words || ' palabras en artista' END,
    CASE WHEN lexical > 0 THEN printf('BM25 (%.3f)', lexical) END,
    CASE WHEN in_title THEN 'frase exacta en título' WHEN in_artist THEN 'frase exacta en artista' END,
    CASE WHEN is_artist THEN 'artista completo' END, CASE WHEN starts THEN 'título comienza con ''' || ({words('q')})[1] || '''' END] if r IS NOT NULL] AS razones
  FROM parts JOIN {stated} ON parts.query_id = stated.query_id WHERE score >= 15
)"""


LEXICAL = lexical(STATED_TABLE)
TITLES = f"(SELECT CAST(id AS BIGINT) AS query_id, {strip('lower(titulo)')} AS q FROM s WHERE CAST(id AS BIGINT) % 50 = 0 AND {strip('lower(titulo)')} <> '') AS stated"
EXCERPT = f"""CASE WHEN letra = '' OR q = '' THEN NULL
  WHEN contains(lower(letra), q) THEN '...' || replace(substring(letra, greatest(strpos(lower(letra), q) - 51, 0) + 1, least(strpos(lower(letra), q) + 99, length(letra)) - greatest(strpos(lower(letra), q) - 51, 0)), chr(10), ' ') || '...'
  WHEN word IS NOT NULL THEN '...' || replace(substring(letra, greatest(strpos(lower(letra), word) - 41, 0) + 1, least(strpos(lower(letra), word) + 59, length(letra)) - greatest(strpos(lower(letra), word) - 41, 0)), chr(10), ' ') || '...'
  WHEN length(letra) > 10 THEN replace(substring(letra, 1, 100), chr(10), ' ') || '...' END"""
WORD = f"list_filter(({words('q')})[1:2], lambda w: length(w) > 3 AND contains(lower(letra), w))[1]"
SNIPPET = f"""CASE WHEN letra = '' THEN '' WHEN pos >= 0 THEN
  CASE WHEN a > 0 THEN '...' ELSE '' END || {strip('substring(letra, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT))')} || CASE WHEN z < length(letra) THEN '...' ELSE '' END END"""
POSITION = f"""CASE WHEN contains(lower(letra), q) THEN strpos(lower(letra), q)
    ELSE strpos(lower(letra), list_filter({words('q')}, lambda w: length(w) > 3 AND contains(lower(letra), w))[1]) END - 1"""

ORACLE: dict[str, str] = {
    "tokens": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, {md5_of('t')} AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "deaccent_lower": f"SELECT doc_id, md5(translate(lower(text), '{ACCENTED}', '{PLAIN}')) AS folded_md5 FROM documents",
    "word_count": f"SELECT doc_id, CAST(len({words('text')}) AS BIGINT) AS n_words FROM documents",
    "lang_detect": f"SELECT doc_id, lang AS idioma FROM ({TEXTS})",
    "lang_histogram": f"SELECT lang AS idioma, count(*) AS n FROM ({TEXTS}) GROUP BY lang",
    "stop_filter": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_kept, {md5_of('t')} AS kept_md5 FROM (SELECT doc_id, {without_stopwords(tokens('text'), 'lang')} AS t FROM ({TEXTS}))",
    "stem_words": f"SELECT word, {', '.join(f'{stem("word", k)} AS stem_{k}' for k in STOPWORDS)} FROM (SELECT DISTINCT unnest({tokens('text')}) AS word FROM documents)",
    "analyzed_terms": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, {md5_of('t')} AS terms_md5 FROM (SELECT doc_id, {terms(tokens('text'), 'lang')} AS t FROM ({TEXTS}))",
    "tf": f"{INDEX} SELECT term, doc_id, tf FROM postings",
    "postings": f"{INDEX} SELECT term, count(*) AS df, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM postings GROUP BY term",
    "term_stats": f"{INDEX} SELECT term, df, round(ln(n / (df + 1)), 6) AS idf FROM df, n",
    "vocab_size": f"{INDEX} SELECT count(*) AS vocab_size FROM df",
    "doc_len_stats": f"{INDEX} SELECT count(*) AS n_docs, round(avg(doc_len), 6) AS avg_len, CAST(sum(doc_len) AS BIGINT) AS total_len FROM lens",
    "bm25_multi_query": f"{SCORES} SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM scores",
    "bm25_topk": f"{SCORES} {TOP}",
    "bm25_titles": f"{scores(f"(SELECT CAST(id AS INTEGER) AS query_id, {strip('lower(titulo)')} AS q FROM s WHERE CAST(id AS BIGINT) % 50 = 0 AND {strip('lower(titulo)')} <> '')")} {TOP}",
    "bm25_blockmax": f"{scores(TITLES)} {TOP}",
    "hybrid_titles_lexical": f"{lexical(TITLES)} SELECT query_id, doc_id, round(score, 4) AS score, array_to_string(razones, ', ') AS razones FROM results",
    "surface_features": f"WITH s AS ({SONGS}) {SURFACE}",
    "hybrid_no_similarity": f"""{SCORES} SELECT query_id, doc_id, round(score, 4) AS score FROM (
  SELECT x.query_id, x.doc_id, 2.0::DOUBLE * title_words + 2.0::DOUBLE * artist_words + 1.5::DOUBLE * coalesce(bm25, 0)
    + CASE WHEN in_title OR in_artist THEN 8.0 ELSE 0.0 END + CASE WHEN is_artist THEN 5.0 ELSE 0.0 END + CASE WHEN starts THEN 3.0 ELSE 0.0 END AS score
  FROM ({SURFACE}) x LEFT JOIN scores ON x.query_id = scores.query_id AND x.doc_id = scores.doc_id) WHERE score >= 10""",
    "snippet": f"""WITH s AS ({SONGS}), p AS (
  SELECT query_id, id, letra, q, CASE WHEN contains(lower(letra), q) THEN strpos(lower(letra), q)
    ELSE strpos(lower(letra), list_filter({words('q')}, lambda w: length(w) > 3 AND contains(lower(letra), w))[1]) END - 1 AS pos FROM s, {STATED_TABLE}
), b AS (SELECT *, greatest(pos - 40, 0) AS a, least(pos + length(q) + 80, length(letra)) AS z FROM p)
SELECT query_id, id, CASE WHEN letra = '' THEN '' WHEN pos >= 0 THEN
  CASE WHEN a > 0 THEN '...' ELSE '' END || {strip('substring(letra, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT))')} || CASE WHEN z < length(letra) THEN '...' ELSE '' END END AS snippet FROM b""",
    "reasons_lexical": f"{LEXICAL} SELECT query_id, doc_id, array_to_string(razones, ', ') AS razones FROM results",
    "api_rows_lexical": f"""{LEXICAL}, p AS (SELECT query_id, s.*, score, q, {POSITION} AS pos FROM results JOIN s ON s.id = doc_id),
b AS (SELECT *, greatest(pos - 40, 0) AS a, least(pos + length(q) + 80, length(letra)) AS z FROM p)
SELECT query_id, id, titulo, artista, '' AS album, genero AS generos, '' AS tags, round(score, 2) AS score, 'N/A' AS anio, 'N/A' AS duracion, {SNIPPET} AS snippet, md5(letra) AS letra_md5 FROM b""",
    "console_lexical": f"""{LEXICAL}, rest AS (SELECT query_id, greatest(count(*) - 15, 0) AS more FROM results GROUP BY query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM results),
w AS (SELECT r.*, titulo, artista, genero, letra, {WORD} AS word FROM r JOIN s ON s.id = doc_id WHERE rank <= 15),
e AS (SELECT *, {EXCERPT} AS excerpt FROM w)
SELECT e.query_id, CAST(rank AS INTEGER) AS rank, doc_id, concat_ws(chr(10), printf('%d. [Relevancia: %.2f] 🎵 %s', rank, CAST(score AS DOUBLE), titulo), '   👤 Artista: ' || artista,
  CASE WHEN len(razones) > 0 THEN '   📊 Relevancia por: ' || array_to_string(razones[1:3], ', ') END, '   🏷️  Géneros: ' || genero, '   📝 ' || excerpt) AS text, CAST(more AS BIGINT) AS more
FROM e JOIN rest ON rest.query_id = e.query_id""",
    "detail_view": f"""WITH s AS ({SONGS}), it AS ({analysed("concat_ws(' ', titulo, artista, letra, genero)")})
SELECT id AS doc_id, md5(concat_ws(chr(10), '🎵 ' || titulo, '👤 Artista: ' || artista, '🏷️  Géneros: ' || genero, '🌐 Idioma detectado: ' || CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 'desconocido'
  ELSE CASE lang WHEN 'es' THEN 'Español' WHEN 'en' THEN 'Inglés' WHEN 'fr' THEN 'Francés' WHEN 'pt' THEN 'Portugués' WHEN 'it' THEN 'Italiano' ELSE lang END END, '📝 LETRA COMPLETA:', letra)) AS text_md5
FROM s JOIN it ON it.doc_id = s.id""",
    "console_excerpts": f"WITH s AS ({SONGS}), w AS (SELECT query_id, id, letra, q, {WORD} AS word FROM s, {STATED_TABLE}) SELECT query_id, id, {EXCERPT} AS excerpt FROM w",
    "top_ngrams": f"{NGRAMS} SELECT ngram, total FROM top",
    "tfidf_ngrams": f"""{NGRAMS}, k AS (SELECT c.* FROM c JOIN top USING (ngram)), i AS (
  SELECT ngram, ln((1 + (SELECT count(*) FROM s)) / (1 + count(*))) + 1 AS idf FROM k GROUP BY ngram
), r AS (SELECT doc_id, k.ngram, n * idf AS w FROM k JOIN i USING (ngram))
SELECT doc_id, ngram, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""",
    "embedding_cosine": """WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM d, d q WHERE q.vec_id % 50 = 0
) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) WHERE rank <= 10""",
    "song_id_md5": f"SELECT id AS doc_id, {SONG_ID} AS song_id FROM ({SONGS})",
    "slug_id": f"SELECT id AS doc_id, concat_ws('_', substring(replace(lower(titulo), ' ', '_'), 1, 20), substring(replace(lower(artista), ' ', '_'), 1, 15), CAST((CAST(id AS BIGINT) * 7919) % 100000 AS VARCHAR)) AS slug FROM ({SONGS})",
    "dedupe_first_wins": f"{KEYED} SELECT conv_id, turn, titulo, artista FROM firsts",
    "anti_existing": f"{KEYED} SELECT conv_id, turn FROM r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.kt = r.kt AND k.ka = r.ka)",
    "merge_counts": f"""{KEYED}, c AS (SELECT count(*) AS n, count(*) FILTER (titulo = '' OR artista = '') AS skipped, (SELECT count(*) FROM added) AS added FROM r)
SELECT 'agregada' AS status, added AS n FROM c UNION ALL SELECT 'duplicada', n - skipped - added FROM c UNION ALL SELECT 'omitida', skipped FROM c""",
    "merged_songs": f"{KEYED} SELECT {SONG_ID} AS id, titulo, artista FROM (SELECT * FROM known UNION ALL SELECT * FROM added)",
    "merged_stream": f"{KEYED} SELECT {SONG_ID} AS id, titulo, artista FROM (SELECT * FROM known UNION ALL SELECT * FROM added)",
    "incremental_index": f"{INDEX} SELECT term, df FROM df",
    "segmented_index": f"{INDEX} SELECT term, df FROM df",
    "full_outer_unify": f"""WITH s AS (SELECT *, CAST(id AS BIGINT) AS k FROM ({SONGS}))
SELECT id, CASE WHEN k % 2 = 0 THEN titulo ELSE '' END AS titulo, CASE WHEN k % 2 = 0 THEN artista ELSE '' END AS artista, CASE WHEN k % 3 = 0 THEN genero ELSE '' END AS generos,
  CASE WHEN k % 5 = 0 THEN artista ELSE '' END AS tags, CAST(CASE WHEN k % 7 = 0 THEN length(letra) ELSE 0 END AS BIGINT) AS n_letra
FROM s WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 OR k % 7 = 0""",
    "genres_gathered": "SELECT source AS id, string_agg(coalesce(lang, ''), ',' ORDER BY doc_id) AS generos FROM documents WHERE source <> '' GROUP BY source",
    "rebuilt_index": f"{REBUILT} SELECT term, df FROM df",
    "meta_map_titled": "SELECT page_id, 'author' AS name, CAST(page_id AS VARCHAR) AS content FROM pages UNION ALL SELECT page_id, 'og:id', md5(url) FROM pages",
    "clean_text": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\t\n\x0b\f\r\x{85}\p{Z}]+', ' ', 'g'), '[^\p{L}\p{M}\p{Nd}\p{Pc} \-.,!?]', '', 'g')) AS clean_md5 FROM documents""",
    "genres_collect": "SELECT source AS id, string_agg(lang, ',' ORDER BY doc_id) AS generos FROM documents GROUP BY source",
    "tags_split": r"""SELECT doc_id, CAST(len(tags) AS BIGINT) AS n_tags, array_to_string(tags, '|') AS tags FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_extract(text, '^[^.\n]*'), ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM documents)""",
    "event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "page_title": r"SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages",
    "page_links": """SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, array_to_string(l, '|') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""",
    "scraped_titles": r"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages),
u AS (SELECT page_id, trim(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS h, trim(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS t FROM p)
SELECT page_id, CASE WHEN length(h) < 100 THEN h ELSE t END AS titulo FROM u""",
    "scraped_links": """WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, md5(array_to_string(list_transform(l, lambda x: CASE WHEN starts_with(x, 'http') THEN x ELSE host || x END), '|')) AS links_md5 FROM l""",
    "links_resolved": """SELECT page_id, CAST(place AS INTEGER) AS place, CASE WHEN starts_with(l, 'http') THEN l ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || l END AS link
FROM (SELECT page_id, url, unnest(l) AS l, unnest(range(len(l))) AS place FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))""",
    "frontier_linked": """WITH RECURSIVE p AS (
  SELECT page_id, page_id // 50 AS site, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS l FROM pages
), placed AS (
  SELECT site, path, arg_min(next, md5(path || page_id)) AS next FROM (
    SELECT p.site, p.page_id, f.page_id AS next, unnest(p.l) AS path FROM p JOIN p f ON f.site = p.site AND f.page_id = p.page_id + 1) GROUP BY site, path
), edges AS (
  SELECT a.site, a.path, unnest(l) AS target FROM placed a JOIN p ON p.page_id = a.next
), reached AS (
  SELECT site, path, 0 AS depth FROM placed WHERE next % 10 = 0
  UNION SELECT t.site, t.path, depth + 1 FROM reached r JOIN edges e ON e.site = r.site AND e.path = r.path JOIN placed t ON t.site = e.site AND t.path = e.target WHERE depth < 60
) SELECT 'https://s' || site || '.example.org' || path AS url, min(depth) AS depth FROM reached GROUP BY site, path""",
    "url_relevant": "SELECT page_id, regexp_matches(lower(url) || '/', '/(lyrics|song|artist|album|track|music|cancion|letra|artists|songs|albums)/') AS relevant, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages",
    "url_trusted": "SELECT page_id, contains(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), 'example.org') OR contains(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), 'example.com') AS trusted FROM pages",
}
