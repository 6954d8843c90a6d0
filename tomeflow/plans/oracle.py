"""SQL for the queries, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

# parameters that both sides share; the lists add words that the test texts hold to the fixed ones
KEYWORD, WORD, TITLE, TERMS = "铜灯", "lantern", "焚舟", "一盏不灭的铜灯 lantern"
NOVEL = "bai-ta-ye-hang-lu"
ADS, WEAK = ["雾港小说网"], ["仿佛"]
KINDS = [("listing", ["哪些", "锈蚀"]), ("comparative", ["比较", "短剑"]), ("causal", ["为什么", "lantern"])]
PATTERNS = [r"访问.*频繁", r"not\s+found", r"429|too\s*many\s*requests"]
FINGERPRINTS = ["# phrases", "您的浏览器", "could not be", "", "真相 指向", "Suspects a traitor"]

WS = r"[\x{09}-\x{0d} \x{85}\x{a0}\p{Z}]"
CJK = r"[\x{4e00}-\x{9fff}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(c: str) -> str:
    return strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def kw(c: str, q: str = KEYWORD) -> str:
    low = f"lower(coalesce({c}, ''))"
    return f"CAST((length({low}) - length(replace({low}, '{q.lower()}', ''))) // {len(q)} AS INTEGER)"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


NOVELS = "novels_ AS (SELECT * FROM novels WHERE novel_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY row_id DESC) = 1)"
CHAPTERS = "chapters_ AS (SELECT * FROM chapters WHERE novel_id IS NOT NULL AND chapter_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY novel_id, chapter_id ORDER BY row_id DESC) = 1)"
SUMMARIES = "summaries_ AS (SELECT state_id AS item_pos, novel_id, chapter_id, title, chapter_summary AS summary FROM chapter_task_states WHERE novel_id IS NOT NULL AND chapter_id IS NOT NULL)"
LAST = "last_ AS (SELECT * FROM summaries_ QUALIFY row_number() OVER (PARTITION BY novel_id, chapter_id ORDER BY item_pos DESC) = 1)"
FIRST = "first_ AS (SELECT * FROM summaries_ QUALIFY row_number() OVER (PARTITION BY novel_id, chapter_id ORDER BY item_pos) = 1)"
PLOTS = "plots_ AS (SELECT novel_id, plot_index, p.volume_title, p.start_chapter, p.end_chapter, p.summary FROM (SELECT novel_id, unnest(range(len(metadata.plots)))::INTEGER AS plot_index, unnest(metadata.plots) AS p FROM novels_))"
ALL = f"WITH {NOVELS}, {CHAPTERS}, {SUMMARIES}, {LAST}, {FIRST}, {PLOTS}"


def paragraphs(source: str = "chapters_", min_len: int = 60) -> str:
    return rf"""
    blocks_ AS (
      SELECT novel_id, chapter_id, chapter_index, title, unnest(range(len(b))) AS pos, unnest(b) AS b FROM (
        SELECT novel_id, chapter_id, chapter_index, title,
               list_filter(list_transform(regexp_split_to_array(content, '\n{WS}*\n'), lambda x: {strip('x')}), lambda x: x <> '') AS b
        FROM {source} WHERE length(content) > 0)
    ), runs_ AS (
      SELECT *, sum(CASE WHEN length(b) >= {min_len} OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY novel_id, chapter_id ORDER BY pos) - 1 AS run FROM blocks_
    ), paragraphs_ AS (
      SELECT novel_id, chapter_id, chapter_index, title AS chapter_title, CAST(run AS INTEGER) AS paragraph_index,
             string_agg(CASE WHEN length(b) >= {min_len} THEN b ELSE array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), ' ') END, ' ' ORDER BY pos) AS text
      FROM runs_ GROUP BY novel_id, chapter_id, chapter_index, title, run
    )"""


NOT_BLANK = lambda c: f"length({strip(f"coalesce({c}, '')")}) > 0"
SQL: dict[str, str] = {}

SQL["paragraph_keyword_topk"] = f"""{ALL}, {paragraphs()}
SELECT novel_id, chapter_id, chapter_index, chapter_title, paragraph_index, {kw('text')} AS score, substring(text, 1, 300) AS snippet
FROM paragraphs_ WHERE score > 0 ORDER BY score DESC, novel_id, chapter_index NULLS FIRST, chapter_id, paragraph_index LIMIT 20"""

SQL["chapter_content_keyword"] = f"""{ALL}
SELECT novel_id, chapter_id, title AS chapter_title, {kw('content', WORD)} AS score, substring(content, 1, 300) AS snippet, 'chapter_content' AS source
FROM chapters_ WHERE score > 0 ORDER BY score DESC, novel_id, chapter_index NULLS FIRST, chapter_id LIMIT 10"""

_SUMMARY_HITS = """SELECT s.novel_id, s.chapter_id, coalesce(nullif(c.title, ''), s.title) AS chapter_title, s.score, substring(s.summary, 1, 300) AS snippet, 'chapter_summary' AS source, s.item_pos
FROM (SELECT *, {score} AS score FROM summaries_ WHERE length(summary) > 0 AND score > 0 ORDER BY score DESC, novel_id, chapter_id, item_pos LIMIT {k}) s
LEFT JOIN chapters_ c ON c.novel_id = s.novel_id AND c.chapter_id = s.chapter_id"""
SQL["chapter_summary_keyword"] = f"{ALL} " + _SUMMARY_HITS.format(score=kw("summary"), k=20)

SQL["chapter_search_fallback"] = f"""{ALL}, a AS ({_SUMMARY_HITS.format(score=kw('summary', TITLE), k=12)}),
b AS (SELECT novel_id, chapter_id, title AS chapter_title, {kw('content', TITLE)} AS score, substring(content, 1, 300) AS snippet, 'chapter_content' AS source
      FROM chapters_ WHERE score > 0 AND chapter_id NOT IN (SELECT chapter_id FROM a) ORDER BY score DESC, novel_id, chapter_index NULLS FIRST, chapter_id LIMIT 12)
SELECT * FROM (
  SELECT 1 AS stage, CAST(row_number() OVER (ORDER BY score DESC, novel_id, chapter_id, item_pos) AS INTEGER) AS rank, novel_id, chapter_id, chapter_title, score, snippet, source FROM a
  UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY score DESC, novel_id, chapter_id) AS INTEGER), * FROM b)
ORDER BY stage, rank LIMIT 12"""

SQL["novel_weighted_keyword"] = f"""{ALL}, parts AS (
  SELECT novel_id, 0 AS level, 0::BIGINT AS pos, {kw('summary')} * 3 AS points, summary AS text FROM novels_
  UNION ALL SELECT novel_id, 1, plot_index, {kw('summary')} * 2, summary FROM plots_
  UNION ALL SELECT novel_id, 2, item_pos, {kw('summary')}, summary FROM summaries_
), hits AS (SELECT * FROM parts WHERE points > 0),
picked AS (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY level, pos) AS n FROM hits WHERE level < 2),
chosen AS (SELECT novel_id, level, pos, text FROM picked WHERE n <= 2),
more AS (SELECT h.novel_id, level, pos, text, row_number() OVER (PARTITION BY h.novel_id ORDER BY pos) + coalesce(c.n, 0) AS n FROM hits h LEFT JOIN (SELECT novel_id, count(*) AS n FROM chosen GROUP BY 1) c ON h.novel_id = c.novel_id WHERE level = 2),
texts AS (SELECT novel_id, string_agg(text, chr(10) ORDER BY level, pos) AS snippet FROM (SELECT * FROM chosen UNION ALL SELECT novel_id, level, pos, text FROM more WHERE n <= 3) GROUP BY 1),
scored AS (SELECT novel_id, CAST(sum(points) AS BIGINT) AS points FROM hits GROUP BY 1),
opening AS (SELECT novel_id, content, {kw('content')} AS p FROM (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY chapter_index NULLS FIRST, chapter_id) AS n FROM chapters_) WHERE n = 1)
SELECT n.novel_id, n.title, CAST(coalesce(points, p, 0) AS BIGINT) AS score, substring(coalesce(snippet, content), 1, 400) AS summary
FROM novels_ n LEFT JOIN scored s ON s.novel_id = n.novel_id LEFT JOIN opening o ON o.novel_id = n.novel_id LEFT JOIN texts t ON t.novel_id = n.novel_id
WHERE coalesce(points, p, 0) > 0 ORDER BY score DESC, n.novel_id LIMIT 10"""

SQL["plot_keyword"] = f"""{ALL}
SELECT novel_id, plot_index, volume_title, start_chapter, end_chapter, {kw("concat_ws(' ', coalesce(volume_title, ''), coalesce(start_chapter, ''), coalesce(end_chapter, ''), summary)")} AS score, substring(summary, 1, 500) AS summary
FROM plots_ WHERE length(plots_.summary) > 0 AND score > 0 ORDER BY score DESC, novel_id, plot_index LIMIT 10"""

SQL["chapters_by_range"] = f"""{ALL}
SELECT * FROM (SELECT c.novel_id, c.chapter_id, c.chapter_index, c.title AS chapter_title, coalesce(s.summary, '') AS summary, substring(coalesce(c.content, ''), 1, 500) AS content
FROM chapters_ c LEFT JOIN first_ s ON s.novel_id = c.novel_id AND s.chapter_id = c.chapter_id WHERE c.novel_id = '{NOVEL}' AND c.chapter_index BETWEEN 2 AND 30)
WHERE contains(lower(coalesce(chapter_title, '')), '{KEYWORD}') OR contains(lower(summary), '{KEYWORD}') OR contains(lower(content), '{KEYWORD}')"""

SQL["chapter_by_title"] = f"{ALL} SELECT novel_id, chapter_id, chapter_index, title AS chapter_title FROM chapters_ WHERE novel_id = '{NOVEL}' AND contains(title, '{TITLE}') ORDER BY chapter_index NULLS FIRST, chapter_id LIMIT 1"

SQL["novel_hierarchy_overview"] = f"""{ALL}
SELECT novel_id, title, coalesce(summary, '') AS overall_summary, CAST((SELECT count(*) FROM plots_ p WHERE p.novel_id = n.novel_id) AS INTEGER) AS n_plots,
       (SELECT count(*) FROM chapters_ c WHERE c.novel_id = n.novel_id) AS chapter_count, 'Use chapter_start and chapter_end to get specific chapter summaries' AS warning
FROM novels_ n WHERE novel_id = '{NOVEL}'"""

SQL["split_paragraphs_a"] = f"{ALL}, {paragraphs()} SELECT novel_id, chapter_id, chapter_index, paragraph_index, text FROM paragraphs_"

_JOINED = "CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || chr(10) || x.cur END"
SQL["split_paragraphs_b"] = f"""{ALL}, folded AS (
  SELECT novel_id, chapter_id, list_reduce(
    list_prepend({{'out': CAST([] AS VARCHAR[]), 'cur': ''}}, list_transform(string_split(content, chr(10)), lambda l: {{'out': CAST([] AS VARCHAR[]), 'cur': {strip('l')}}})),
    lambda a, x: {{'out': CASE WHEN x.cur = '' THEN (CASE WHEN a.cur = '' THEN a.out ELSE list_append(a.out, a.cur) END) WHEN length({_JOINED}) >= 100 THEN list_append(a.out, {_JOINED}) ELSE a.out END,
                   'cur': CASE WHEN x.cur = '' OR length({_JOINED}) >= 100 THEN '' ELSE {_JOINED} END}}) AS f
  FROM chapters_ WHERE length(content) > 0
), lists AS (SELECT novel_id, chapter_id, CASE WHEN f.cur = '' THEN f.out ELSE list_append(f.out, f.cur) END AS p FROM folded)
SELECT novel_id, chapter_id, CAST(unnest(range(len(p))) AS INTEGER) AS paragraph_index, unnest(p) AS text FROM lists"""


def packed(source: str, keys: str, list_col: str, max_chars: int) -> str:
    """Folds a list column of ``source`` into buckets, as the operator does."""
    cut = f"list_transform(range(0, length(x.cur), {max_chars}), lambda i: substring(x.cur, CAST(i + 1 AS BIGINT), {max_chars}))"
    closed = "CASE WHEN a.cur = '' THEN a.out ELSE list_append(a.out, a.cur) END"
    fits = f"a.size + length(x.cur) + 1 <= {max_chars}"
    return f"""folded_ AS (SELECT {keys}, list_reduce(
    list_prepend({{'out': CAST([] AS VARCHAR[]), 'cur': '', 'size': 0::BIGINT}}, list_transform({list_col}, lambda item: {{'out': CAST([] AS VARCHAR[]), 'cur': item, 'size': 0::BIGINT}})),
    lambda a, x: {{'out': CASE WHEN x.cur = '' THEN a.out WHEN length(x.cur) > {max_chars} THEN list_concat({closed}, {cut}) WHEN {fits} OR a.cur = '' THEN a.out ELSE {closed} END,
      'cur': CASE WHEN x.cur = '' THEN a.cur WHEN length(x.cur) > {max_chars} THEN '' WHEN {fits} AND a.cur <> '' THEN a.cur || chr(10) || x.cur ELSE x.cur END,
      'size': CASE WHEN x.cur = '' THEN a.size WHEN length(x.cur) > {max_chars} THEN 0 WHEN {fits} THEN a.size + length(x.cur) + 1 ELSE length(x.cur) END}}) AS f FROM {source}),
  packed_ AS (SELECT {keys}, CASE WHEN f.cur = '' THEN f.out ELSE list_append(f.out, f.cur) END AS p FROM folded_)"""


SQL["segment_pack"] = f"""{ALL}, {paragraphs()}, listed_ AS (SELECT novel_id, chapter_id, list(text ORDER BY paragraph_index) AS l FROM paragraphs_ GROUP BY 1, 2), {packed('listed_', 'novel_id, chapter_id', 'l', 800)},
some_ AS (SELECT c.novel_id, c.chapter_id, CASE WHEN p.p IS NOT NULL AND len(p.p) > 0 THEN p.p WHEN c.content = '' THEN CAST([] AS VARCHAR[]) ELSE [substring(c.content, 1, 800)] END AS p
  FROM chapters_ c LEFT JOIN packed_ p ON p.novel_id = c.novel_id AND p.chapter_id = c.chapter_id WHERE c.content IS NOT NULL)
SELECT novel_id, chapter_id, CAST(unnest(range(len(p))) AS INTEGER) AS segment_index, unnest(p) AS text FROM some_"""

SQL["item_pack"] = f"""WITH items_ AS (SELECT state_id, list_filter(segment_texts, lambda x: x IS NOT NULL) AS l FROM chapter_task_states WHERE segment_texts IS NOT NULL), {packed('items_', 'state_id', 'l', 1500)}
SELECT state_id, CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS text FROM packed_"""

SQL["segment_length_stats"] = """SELECT novel_id, count(*) AS n, CAST(min(length(s)) AS INTEGER) AS shortest, CAST(max(length(s)) AS INTEGER) AS longest, round(avg(length(s)), 6) AS mean
FROM (SELECT novel_id, unnest(segment_texts) AS s FROM chapter_task_states) WHERE s IS NOT NULL GROUP BY novel_id"""

SQL["chapter_headings"] = rf"""{ALL}, w AS (SELECT novel_id, chapter_id, regexp_split_to_array({strip('substring(content, 1, 200)')}, '{WS}+') AS w FROM chapters_)
SELECT novel_id, chapter_id, concat_ws(' ', w[1], w[2]) AS heading FROM w WHERE regexp_matches(w[1], '^第[〇零一二三四五六七八九十百千万两0-9]+章$')"""

_VOLUME = lambda t: rf"coalesce(nullif(regexp_extract({t}, '第.{{1,6}}卷'), ''), nullif(regexp_extract({t}, '(?i)Volume{WS}+[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), ''), CASE WHEN contains({t}, '卷') AND length({t}) <= 20 THEN {strip(t)} END)"
SQL["volume_titles"] = f"{ALL} SELECT novel_id, plot_index, {_VOLUME('volume_title')} AS volume FROM plots_"

SQL["volume_groups"] = f"""{ALL}, t AS (SELECT novel_id, chapter_id, chapter_index, CASE WHEN chapter_index % 5 = 0 THEN '第' || CAST(chapter_index // 5 + 1 AS INTEGER) || '卷 ' || coalesce(title, '') ELSE coalesce(title, '') END AS title FROM chapters_),
v AS (SELECT *, {_VOLUME('title')} AS volume FROM t),
r AS (SELECT *, sum(CASE WHEN volume IS NULL THEN 0 ELSE 1 END) OVER w AS run, coalesce(last_value(volume IGNORE NULLS) OVER w, '未分卷') AS volume_title FROM v WINDOW w AS (PARTITION BY novel_id ORDER BY chapter_index NULLS FIRST, chapter_id)),
s AS (SELECT r.*, l.summary FROM r JOIN last_ l ON l.novel_id = r.novel_id AND l.chapter_id = r.chapter_id WHERE length(l.summary) > 0)
SELECT novel_id, CAST(run AS BIGINT) AS run, volume_title, first(title ORDER BY chapter_index, chapter_id) AS start_chapter, last(title ORDER BY chapter_index, chapter_id) AS end_chapter,
       string_agg(title || ': ' || summary, chr(10) ORDER BY chapter_index, chapter_id) AS items
FROM s GROUP BY novel_id, run, volume_title"""

SQL["chapter_metadata"] = f"""{ALL}
SELECT novel_id, chapter_id, coalesce(metadata['chapter_index'], CASE WHEN NOT coalesce(map_contains(metadata, 'chapter_index'), false) THEN CAST(chapter_index AS VARCHAR) END) AS meta_index,
  CASE WHEN coalesce(map_contains(metadata, 'chapter_title'), false) THEN metadata['chapter_title'] ELSE title END AS meta_title,
  CAST(coalesce(cardinality(metadata), 0) + CASE WHEN coalesce(map_contains(metadata, 'chapter_index'), false) THEN 0 ELSE 1 END + CASE WHEN coalesce(map_contains(metadata, 'chapter_title'), false) THEN 0 ELSE 1 END AS INTEGER) AS n
FROM chapters_"""

SQL["novel_slugs"] = rf"{ALL} SELECT novel_id, regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM novels_"

_ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
SQL["html_paragraphs"] = f"""{ALL}, p AS (SELECT novel_id, chapter_id, list_filter(list_transform(list_filter(string_split(content, chr(10)), lambda x: {strip('x')} <> '' AND {strip('x')} <> {strip('title')}), lambda x: {strip(_ESC('x'))}), lambda x: x <> '') AS l FROM chapters_ WHERE content IS NOT NULL AND title IS NOT NULL)
SELECT novel_id, chapter_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS text FROM p"""
SQL["html_title"] = f"{ALL} SELECT novel_id, chapter_id, {strip(_ESC('title'))} AS title FROM chapters_ WHERE content IS NOT NULL AND title IS NOT NULL"

_LINES = f"""lines_ AS (SELECT novel_id, chapter_id, CAST(unnest(range(len(l))) AS INTEGER) AS index, unnest(l) AS text FROM (
  SELECT novel_id, chapter_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM chapters_))"""


def _is_ad(words: list[str]) -> str:
    patterns = [r"(?i)https?://", rf"(?i)www\.[^\x{{09}}-\x{{0d}} \x{{85}}\x{{a0}}\p{{Z}}]+", "（?本文来自.+）?", "（?求.{0,6}票.{0,6}）", rf"PS(?:[.：:]|{WS}).{{0,80}}(月票|推荐|粉丝节|投票|支持|赞赏)"]
    return "(" + any_of("text", words) + "".join(f" OR regexp_matches(text, '{p}')" for p in patterns) + ")"


def _fixed() -> tuple[list[str], list[str]]:
    from tomeflow.operators.cleaning import AD_WORDS, WEAK_WORDS

    return AD_WORDS, WEAK_WORDS


AD_WORDS_, WEAK_WORDS_ = _fixed()
SQL["ad_rule_filter"] = f"{ALL}, {_LINES} SELECT * FROM lines_ WHERE {_is_ad([*AD_WORDS_, *ADS])}"
SQL["suspicious_filter"] = f"""{ALL}, {_LINES}, t AS (SELECT *, count(*) OVER (PARTITION BY novel_id, chapter_id) AS total FROM lines_)
SELECT novel_id, chapter_id, index, text FROM t WHERE length(text) <= 200 AND (index < 2 OR index >= total - 3) AND {any_of('text', [*WEAK_WORDS_, *WEAK])}"""
SQL["clean_chapters"] = f"""{ALL}, {_LINES}, k AS (SELECT * FROM lines_ WHERE NOT {_is_ad(AD_WORDS_)})
SELECT novel_id, chapter_id, CAST(dense_rank() OVER (PARTITION BY novel_id ORDER BY chapter_id) AS INTEGER) AS chapter_no, index, text FROM k"""

SQL["chunk_build"] = f"""{ALL}, b_ AS ({SQL['split_paragraphs_b'][len(ALL) + 2:].join(['WITH ', ''])})
SELECT novel_id || '/overall/overall' AS chunk_id, title AS novel_title, '【全书总结】' || substring(summary, 1, 4000) AS content, 'overall_summary' AS content_type, CAST(NULL AS INTEGER) AS chapter_index, CAST(NULL AS VARCHAR) AS volume_title FROM novels_ WHERE length(summary) > 0
UNION ALL SELECT p.novel_id || '/plot/v_' || plot_index, n.title, '【' || coalesce(volume_title, '未分卷') || '】' || coalesce(start_chapter, '') || ' - ' || coalesce(end_chapter, '') || chr(10) || substring(p.summary, 1, 4000), 'plot_summary', NULL, coalesce(volume_title, '未分卷')
  FROM plots_ p JOIN novels_ n ON n.novel_id = p.novel_id WHERE length(p.summary) > 0
UNION ALL SELECT c.novel_id || '/chapter_summary/' || c.chapter_id, n.title, '【' || coalesce(c.title, '') || '】' || substring(l.summary, 1, 4000), 'chapter_summary', c.chapter_index, {_VOLUME('c.title')}
  FROM chapters_ c JOIN last_ l ON l.novel_id = c.novel_id AND l.chapter_id = c.chapter_id JOIN novels_ n ON n.novel_id = c.novel_id WHERE length(l.summary) > 0
UNION ALL SELECT b.novel_id || '/paragraph/' || b.chapter_id || '_p' || b.paragraph_index, n.title, substring(b.text, 1, 500), 'paragraph', c.chapter_index, {_VOLUME('c.title')}
  FROM b_ b JOIN chapters_ c ON c.novel_id = b.novel_id AND c.chapter_id = b.chapter_id JOIN novels_ n ON n.novel_id = b.novel_id"""

SQL["chunk_count_by_type"] = "SELECT content_type, count(*) AS n FROM chunks GROUP BY content_type"
SQL["chunk_totals"] = "SELECT novel_id, count(*) AS n, CAST(sum(CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM chunks GROUP BY novel_id"
SQL["chunk_upsert"] = """WITH stored AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL AND vec_id % 2 = 0 AND embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY vec_id DESC) = 1),
fresh AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL AND len(embedding) > 0 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY vec_id DESC) = 1)
SELECT chunk_id, vec_id, content_type FROM stored WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh) UNION ALL SELECT chunk_id, vec_id, content_type FROM fresh"""
SQL["reindex_pending"] = f"{ALL} SELECT novel_id FROM novels_ WHERE novel_id NOT IN (SELECT novel_id FROM chunks WHERE content_type = 'overall_summary' AND novel_id IS NOT NULL)"
SQL["export_list"] = f"{ALL} SELECT novel_id, title FROM novels_"
_OPENING = "opening_ AS (SELECT novel_id, content AS opening FROM chapters_ QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY chapter_index NULLS FIRST, chapter_id) = 1)"
SQL["export_chunks"] = f"""{ALL}, {_OPENING}
SELECT n.novel_id || ':summary' AS id, coalesce(nullif(summary, ''), substring(opening, 1, 800), '') AS content, 'novel_summary' AS content_type, n.novel_id AS source_id, title AS source_title, CAST(NULL AS VARCHAR) AS meta_index, created_at FROM novels_ n LEFT JOIN opening_ o ON o.novel_id = n.novel_id
UNION ALL SELECT c.novel_id || ':' || chapter_id, content, 'chapter', c.novel_id, n.title, CASE WHEN coalesce(map_contains(c.metadata, 'chapter_index'), false) THEN c.metadata['chapter_index'] ELSE CAST(chapter_index AS VARCHAR) END, created_at FROM chapters_ c JOIN novels_ n ON n.novel_id = c.novel_id"""
SQL["novel_summaries"] = f"{ALL}, {_OPENING} SELECT n.novel_id, coalesce(nullif(summary, ''), substring(opening, 1, 800), '') AS summary FROM novels_ n LEFT JOIN opening_ o ON o.novel_id = n.novel_id"

_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM chunks WHERE len(embedding) = 64 ORDER BY vec_id LIMIT 1)"


def cos(c: str) -> str:
    e = f"CAST({c} AS DOUBLE[])"
    return f"round(CASE WHEN {c} IS NULL OR len({c}) <> 64 THEN 0.0 WHEN list_sum(list_transform({e}, lambda x: x * x)) > 0 THEN list_sum(list_transform(list_zip({e}, (SELECT q FROM q)), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform({e}, lambda x: x * x))) * sqrt(list_sum(list_transform((SELECT q FROM q), lambda x: x * x)))) ELSE 0.0 END, 6)"


_SCORED = f"scored_ AS (SELECT vec_id, chunk_id, content_type, novel_id, chapter_index, {cos('embedding')} AS score FROM chunks WHERE len(embedding) > 0)"
SQL["vector_cosine_topk"] = f"WITH {_Q}, {_SCORED} SELECT vec_id, chunk_id, score FROM scored_ ORDER BY score DESC, novel_id NULLS FIRST, chunk_id NULLS FIRST, vec_id LIMIT 20"
SQL["vector_filtered_topk"] = f"WITH {_Q}, {_SCORED} SELECT vec_id, chunk_id, score FROM scored_ WHERE content_type = 'chapter_summary' AND novel_id = '{NOVEL}' ORDER BY score DESC, novel_id, chunk_id, vec_id LIMIT 10"
SQL["vector_paragraph_range"] = f"WITH {_Q}, {_SCORED} SELECT vec_id, chunk_id, chapter_index, score FROM (SELECT * FROM scored_ WHERE content_type = 'paragraph' AND novel_id = '{NOVEL}' ORDER BY score DESC, chunk_id, vec_id LIMIT 30) WHERE chapter_index BETWEEN 0 AND 20 ORDER BY score DESC, chunk_id, vec_id LIMIT 15"
SQL["novel_semantic"] = f"{ALL}, {_Q} SELECT novel_id, title, {cos('summary_embedding')} AS score FROM novels_ WHERE len(summary_embedding) > 0 ORDER BY score DESC, novel_id LIMIT 10"


def tokens(c: str) -> str:
    words = rf"list_filter(regexp_split_to_array(regexp_replace({c}, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{09}}-\x{{0d}} \x{{85}}\x{{a0}}\p{{Z}}]', ' ', 'g'), '{WS}+'), lambda w: w <> '')"
    chars = f"regexp_extract_all(w, '{CJK}')"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN regexp_full_match(w, '[a-zA-Z]+') THEN [lower(w)] ELSE list_concat({chars}, list_transform(range(1, greatest(len({chars}), 1)), lambda i: {chars}[i] || {chars}[i + 1])) END))"


SQL["tokenize_explode"] = f"{ALL}, t AS (SELECT novel_id, {tokens('summary')} AS t FROM novels_ WHERE summary IS NOT NULL) SELECT novel_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM t"
_BM25 = f"""{ALL}, {paragraphs()}, tok_ AS (SELECT novel_id, chapter_id, chapter_index, chapter_title, paragraph_index, text, {tokens('text')} AS t FROM paragraphs_),
sizes_ AS (SELECT novel_id, count(*) AS n, avg(len(t)) AS avgdl FROM tok_ GROUP BY 1),
df_ AS (SELECT novel_id, term, count(*) AS df FROM (SELECT novel_id, unnest(list_distinct(t)) AS term FROM tok_) GROUP BY 1, 2),
raw_ AS (SELECT d.novel_id, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df_ d JOIN sizes_ s ON s.novel_id = d.novel_id),
idf_ AS (SELECT r.novel_id, term, df, n, avgdl, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM raw_ r JOIN (SELECT novel_id, avg(raw) * 0.25 AS floor FROM raw_ GROUP BY 1) f ON f.novel_id = r.novel_id)"""
SQL["bm25_df"] = f"{_BM25} SELECT novel_id, term, df, round(idf, 6) AS idf FROM idf_"
SQL["bm25_topk"] = f"""{_BM25}, q_ AS (SELECT unnest({tokens(f"'{TERMS}'")}) AS term), w_ AS (SELECT term, count(*) AS w FROM q_ GROUP BY 1),
hit_ AS (SELECT t.novel_id, chapter_id, chapter_index, chapter_title, paragraph_index, text, len(list_filter(t, lambda x: x = w_.term)) AS tf, len(t) AS dl, w, idf, avgdl FROM tok_ t JOIN w_ ON list_contains(t.t, w_.term) JOIN idf_ i ON i.novel_id = t.novel_id AND i.term = w_.term),
s_ AS (SELECT novel_id, chapter_id, chapter_index, chapter_title, paragraph_index, text, sum(idf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM hit_ GROUP BY ALL HAVING score > 0),
b_ AS (SELECT * FROM s_ QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY round(score, 9) DESC, chapter_index, chapter_id, paragraph_index) <= 40)
SELECT novel_id, chapter_id, chapter_index, chapter_title, paragraph_index, round(score, 6) AS score, substring(text, 1, 300) AS snippet FROM b_ ORDER BY round(score, 6) DESC, novel_id, chapter_index NULLS FIRST, chapter_id, paragraph_index LIMIT 20"""

SQL["hybrid_fusion"] = f"""{ALL}, {_Q}, n_ AS (SELECT novel_id, chapter_id, {cos('embedding')} AS score FROM chapters WHERE len(embedding) = 64),
v_ AS (SELECT novel_id, chapter_id, max(score) AS score FROM n_ GROUP BY 1, 2 ORDER BY score DESC, novel_id, chapter_id LIMIT 20),
k_ AS (SELECT novel_id, chapter_id, {kw('content')} AS score FROM chapters_ WHERE score > 0 ORDER BY score DESC, novel_id, chapter_id LIMIT 20)
SELECT coalesce(v.novel_id, k.novel_id) AS novel_id, coalesce(v.chapter_id, k.chapter_id) AS chapter_id, coalesce(v.score, 0.0) AS vector_score, CAST(coalesce(k.score, 0) AS DOUBLE) AS keyword_score,
  round(0.6 * coalesce(v.score / greatest((SELECT max(score) FROM v_), 0.001), 0) + 0.4 * coalesce(k.score / greatest((SELECT max(score) FROM k_), 0.001), 0), 6) AS score
FROM v_ v FULL JOIN k_ k ON v.novel_id = k.novel_id AND v.chapter_id = k.chapter_id ORDER BY score DESC, novel_id, chapter_id LIMIT 20"""

_PARTS = "coalesce(TRY_CAST(element_at(metadata, 'paragraph_index')[1] AS INTEGER), TRY_CAST(nullif(regexp_extract(chunk_id, '_p(\\d+)$', 1), '') AS INTEGER))".replace("\\\\", "\\")
SQL["hybrid_paragraphs"] = f"""WITH {_Q}, k_ AS (SELECT * FROM ({SQL['bm25_topk']})),
n_ AS (SELECT novel_id, chapter_id, {_PARTS} AS paragraph_index, {cos('embedding')} AS score FROM chunks WHERE len(embedding) = 64 AND content_type = 'paragraph'),
v_ AS (SELECT novel_id, chapter_id, paragraph_index, max(score) AS score FROM n_ WHERE paragraph_index IS NOT NULL GROUP BY 1, 2, 3 ORDER BY score DESC, novel_id NULLS FIRST, chapter_id NULLS FIRST, paragraph_index LIMIT 20)
SELECT coalesce(v.novel_id, k.novel_id) AS novel_id, coalesce(v.chapter_id, k.chapter_id) AS chapter_id, coalesce(v.paragraph_index, k.paragraph_index) AS paragraph_index, coalesce(v.score, 0.0) AS vector_score, coalesce(k.score, 0.0) AS keyword_score,
  round(0.6 * coalesce(v.score / greatest((SELECT max(score) FROM v_), 0.001), 0) + 0.4 * coalesce(k.score / greatest((SELECT max(score) FROM k_), 0.001), 0), 6) AS score
FROM v_ v FULL JOIN k_ k ON v.novel_id = k.novel_id AND v.chapter_id = k.chapter_id AND v.paragraph_index = k.paragraph_index ORDER BY score DESC, novel_id NULLS FIRST, chapter_id NULLS FIRST, paragraph_index LIMIT 20"""
SQL["chapter_semantic"] = f"""{ALL}, {_Q} SELECT novel_id, chapter_id, {cos('embedding')} AS score, substring(content, 1, 300) AS snippet FROM chapters_ WHERE length(content) > 0 AND len(embedding) = 64
ORDER BY score DESC, novel_id, chapter_index NULLS FIRST, chapter_id LIMIT 10"""
SQL["hit_indices"] = f"""{ALL}, h_ AS (SELECT novel_id, chapter_id, {kw('summary')} AS score, item_pos FROM summaries_ WHERE length(summary) > 0 AND score > 0 ORDER BY score DESC, novel_id, chapter_id, item_pos LIMIT 20)
SELECT novel_id, chapter_id, min(chapter_index) AS chapter_index FROM chapters_ WHERE (novel_id, chapter_id) IN (SELECT (novel_id, chapter_id) FROM h_) GROUP BY 1, 2"""
SQL["export_with_vectors"] = f"""{ALL} SELECT novel_id || ':summary' AS id, 'novel_summary' AS content_type, CAST(coalesce(len(summary_embedding), -1) AS INTEGER) AS n_numbers FROM novels_
UNION ALL SELECT c.novel_id || ':' || c.chapter_id, 'chapter', CAST(coalesce(len(c.embedding), -1) AS INTEGER) FROM chapters_ c JOIN novels_ n ON n.novel_id = c.novel_id"""
_KINDS = [("quota_exhausted", "disable", ["allocationquota", "quota", "insufficient"]), ("upstream_5xx", "throttle", ["502", "503", "504", "bad gateway", "cloudflare"]), ("rate_limited", "throttle", ["429", "rate limit", "too many requests"]), ("network_error", "throttle", ["timeout", "timed out", "connection"])]
SQL["error_decisions"] = "WITH e AS (SELECT state_id, unnest(map_keys(segment_errors)) AS segment_no, lower(coalesce(unnest(map_values(segment_errors)), '')) AS v FROM chapter_task_states) SELECT state_id, segment_no, CASE " + " ".join(f"WHEN {any_of('v', w)} THEN '{a}'" for _, a, w in _KINDS) + " END AS action, CASE " + " ".join(f"WHEN {any_of('v', w)} THEN '{r}'" for r, _, w in _KINDS) + " END AS reason FROM e"

_NORM = f"lower(regexp_replace(summary, '{WS}+', '', 'g'))"
_PATTERN = " OR ".join(f"regexp_matches(summary, '(?i){p.replace(chr(92) + 's', WS)}')" for p in PATTERNS)
# RE2 has no references back, so a character's run of nine is looked for by comparing neighbours
_RUN = "coalesce(list_bool_or(list_transform(range(1, greatest(length(summary) - 7, 1)), lambda i: substring(summary, i, 9) = repeat(substring(summary, i, 1), 9) AND substring(summary, i, 1) <> chr(10))), false)"
SQL["audit_rules"] = f"""WITH a AS (SELECT audit_id, {_NORM} AS n, {_PATTERN} AS failed, {_RUN} AS run FROM suspicious_summaries WHERE {NOT_BLANK('summary')})
SELECT audit_id, CAST(round(CASE WHEN length(n) < 20 THEN 0.45 ELSE 0 END + CASE WHEN failed THEN 0.9 ELSE 0 END + CASE WHEN run THEN 0.3 ELSE 0 END, 3) AS DOUBLE) AS score,
  concat_ws('|', CASE WHEN length(n) < 20 THEN 'too_short<20' END, CASE WHEN failed THEN 'matches_failure_pattern' END, CASE WHEN run THEN 'repeated_chars' END) AS why
FROM a WHERE length(n) < 20 OR failed OR run"""
_PRINTS = [(p.strip(), "".join(p.lower().split())) for p in FINGERPRINTS if p.strip() and not p.startswith("#")]
_HELD = "CASE " + " ".join(f"WHEN contains({_NORM}, '{n}') THEN '{p}'" for p, n in _PRINTS) + " END"
SQL["audit_fingerprint_contains"] = f"""WITH a AS (SELECT audit_id, {_HELD} AS held, {_RUN} AS run FROM suspicious_summaries WHERE {NOT_BLANK('summary')})
SELECT audit_id, round(1.0 + CASE WHEN run THEN 0.3 ELSE 0 END, 3)::DOUBLE AS score, concat_ws('|', 'contains_fingerprint:' || held, CASE WHEN run THEN 'repeated_chars' END) AS why FROM a WHERE held IS NOT NULL"""
SQL["audit_clean"] = f"WITH f AS ({SQL['audit_rules']}) SELECT audit_id, summary FROM suspicious_summaries WHERE audit_id NOT IN (SELECT audit_id FROM f WHERE score >= 0.9)"

SQL["summary_status"] = f"""{ALL} SELECT l.novel_id, l.chapter_id, CASE WHEN NOT {NOT_BLANK('c.content')} THEN 'chapter_content_empty' WHEN s.status = 'FAILED' THEN 'model_summary_error' WHEN NOT {NOT_BLANK('l.summary')} THEN 'model_summary_empty' ELSE 'ok' END AS summary_status
FROM last_ l JOIN chapter_task_states s ON s.state_id = l.item_pos JOIN chapters_ c ON c.novel_id = l.novel_id AND c.chapter_id = l.chapter_id"""
SQL["compact_errors"] = f"""WITH e AS (SELECT state_id, unnest(map_keys(segment_errors)) AS segment_no, unnest(map_values(segment_errors)) AS v FROM chapter_task_states),
c AS (SELECT state_id, segment_no, lower(coalesce(v, '')) AS low, {collapse("coalesce(v, '')")} AS s FROM e)
SELECT state_id, segment_no, CASE WHEN (contains(low, '<!doctype html') OR contains(low, '<html')) AND (contains(low, '502') OR contains(low, 'bad gateway')) THEN 'upstream_502_bad_gateway_html'
  WHEN contains(low, '<!doctype html') OR contains(low, '<html') THEN 'upstream_html_error_response' WHEN length(s) > 60 THEN substring(s, 1, 59) || '…' ELSE s END AS error FROM c"""
SQL["text_tiers"] = "SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 300 THEN 'short' WHEN length(text) >= 1500 THEN 'long' ELSE 'medium' END AS tier FROM documents"
SQL["question_classify"] = "SELECT doc_id, CASE " + " ".join(f"WHEN {any_of('lower(text)', w)} THEN '{n}'" for n, w in KINDS) + " ELSE 'general' END AS kind FROM documents WHERE text IS NOT NULL"
_UNSURE = ["我不知道", "无法回答", "不确定", "不清楚", "没有找到", "i don''t know", "cannot answer", "not sure", "not found", "insufficient", WORD]
SQL["confident_texts"] = f"{ALL} SELECT item_pos, NOT {any_of("lower(coalesce(summary, ''))", _UNSURE)} AND length({strip("coalesce(summary, '')")}) > 10 AS sure FROM summaries_"

SQL["pending_chapters"] = f"{ALL} SELECT novel_id, chapter_id, chapter_index FROM chapters_ c WHERE NOT EXISTS (SELECT 1 FROM last_ l WHERE l.novel_id = c.novel_id AND l.chapter_id = c.chapter_id AND {NOT_BLANK('l.summary')})"
SQL["contiguous_progress"] = f"""{ALL}, d AS (SELECT c.novel_id, row_number() OVER (PARTITION BY c.novel_id ORDER BY chapter_index NULLS FIRST, c.chapter_id) AS n, s.chapter_id IS NOT NULL AS done FROM chapters_ c LEFT JOIN last_ s ON s.novel_id = c.novel_id AND s.chapter_id = c.chapter_id)
SELECT novel_id, count(*) AS chapter_count, coalesce(min(CASE WHEN NOT done THEN n END) - 1, count(*)) AS done_index FROM d GROUP BY novel_id"""
SQL["restored_progress"] = f"""{ALL}, d AS (SELECT c.novel_id, row_number() OVER (PARTITION BY c.novel_id ORDER BY chapter_index NULLS FIRST, c.chapter_id) AS n, s.chapter_id IS NOT NULL AS saved, {NOT_BLANK('s.summary')} AS good FROM chapters_ c LEFT JOIN last_ s ON s.novel_id = c.novel_id AND s.chapter_id = c.chapter_id),
g AS (SELECT novel_id, count(*) AS total, min(CASE WHEN NOT (saved AND good) THEN n END) AS stop FROM d GROUP BY novel_id)
SELECT g.novel_id, coalesce(stop - 1 + CASE WHEN d.saved THEN 1 ELSE 0 END, total) AS kept, coalesce(stop - 1, total) AS done_index FROM g LEFT JOIN d ON d.novel_id = g.novel_id AND d.n = g.stop"""
SQL["consistency_missing_extra"] = f"""{ALL} SELECT novel_id, chapter_id, 'missing_summary' AS issue FROM (SELECT novel_id, chapter_id FROM chapters_ EXCEPT SELECT novel_id, chapter_id FROM summaries_)
UNION ALL SELECT novel_id, chapter_id, 'extra_summary' FROM (SELECT novel_id, chapter_id FROM summaries_ EXCEPT SELECT novel_id, chapter_id FROM chapters_)"""
SQL["repeated_chapter_ids"] = "SELECT novel_id, chapter_id, count(*) AS n FROM chapters WHERE novel_id IS NOT NULL AND chapter_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"
SQL["title_mismatch"] = f"{ALL} SELECT c.novel_id, c.chapter_id, c.title AS chapter_title, l.title AS summary_title FROM chapters_ c JOIN last_ l ON l.novel_id = c.novel_id AND l.chapter_id = c.chapter_id WHERE c.title IS DISTINCT FROM l.title"
SQL["title_sync"] = f"""{ALL} SELECT l.novel_id, l.chapter_id, coalesce(nullif(c.title, ''), l.title) AS title, CASE WHEN c.chapter_id IS NULL THEN 'missing' WHEN coalesce(nullif(c.title, ''), l.title) IS NOT DISTINCT FROM l.title THEN 'same' ELSE 'updated' END AS title_state
FROM last_ l LEFT JOIN chapters_ c ON l.novel_id = c.novel_id AND l.chapter_id = c.chapter_id"""
SQL["dedupe_first_wins"] = f"""WITH c AS (SELECT novel_id, row_id, unnest(range(len(characters))) AS place, unnest(characters) AS c FROM novels WHERE novel_id IS NOT NULL),
k AS (SELECT novel_id, row_id * 1000 + place AS pos, c.name, c.role, c.relationships, coalesce(nullif(lower({strip('c.name')}), ''), CAST(c AS VARCHAR)) AS k FROM c)
SELECT novel_id, pos, name, role, relationships FROM k QUALIFY row_number() OVER (PARTITION BY novel_id, k ORDER BY pos) = 1"""
SQL["ownership_semi"] = f"{ALL} SELECT novel_id, chapter_id, title FROM chapters_ WHERE novel_id IN (SELECT novel_id FROM novels_ WHERE length(novel_id) % 3 = 1)"
SQL["hashed_keys"] = f"{ALL} SELECT novel_id, sha256(novel_id) AS api_key FROM novels_"
SQL["sanitized_summaries"] = rf"""{ALL}, s AS (SELECT item_pos, {strip("coalesce(summary, '')")} AS s FROM summaries_)
SELECT item_pos, CASE WHEN regexp_matches(lower(s), '请提供.*(内容|主题|文本)|未提供.*(主题|内容|文本)|无法生成.*(总结|摘要)|我是一个ai助手|这是一个(示例|通用|简短).*(总结|摘要)|json格式的输出|return{WS}+json|rate{WS}*limit|429|too{WS}*many{WS}*requests|api{WS}*error|providererror') THEN '' ELSE s END AS summary FROM s"""
SQL["plot_ranges"] = f"""{ALL}, j AS (SELECT p.novel_id, plot_index, max(CASE WHEN length(start_chapter) > 0 AND (contains(coalesce(title, ''), start_chapter) OR chapter_id = start_chapter) THEN chapter_index END) AS first_index,
  max(CASE WHEN length(end_chapter) > 0 AND (contains(coalesce(title, ''), end_chapter) OR chapter_id = end_chapter) THEN chapter_index END) AS last_index FROM plots_ p JOIN chapters_ c ON c.novel_id = p.novel_id GROUP BY 1, 2)
SELECT * FROM j WHERE first_index IS NOT NULL AND last_index IS NOT NULL"""

# ---- pages


_PAGE_LINES = f"list_filter(string_split(content, chr(10)), lambda x: {strip('x')} <> '' AND {strip('x')} <> {strip('title')})"
SQL["html_pages"] = f"""{ALL} SELECT novel_id, chapter_id, '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || {_ESC('title')} || '</title><link rel="stylesheet" type="text/css" href="style/default.css"/></head><body>' || chr(10)
  || array_to_string(list_prepend('<h2>' || {_ESC('title')} || '</h2>', list_transform({_PAGE_LINES}, lambda x: '<p>' || {_ESC('x')} || '</p>')), chr(10)) || chr(10) || '</body></html>' AS page
FROM chapters_ WHERE content IS NOT NULL AND title IS NOT NULL"""
# what was escaped comes back, so the text is the title, twice, and the lines
SQL["html_strip"] = f"{ALL} SELECT novel_id, chapter_id, {collapse(f"title || ' ' || array_to_string(list_prepend(title, {_PAGE_LINES}), ' ')")} AS text FROM chapters_ WHERE content IS NOT NULL AND title IS NOT NULL"

_RESERVED = ["novel_id", "novel_title", "content_type", "chapter_id", "chapter_index", "chapter_title", "volume_title"]
_FILLED = lambda c: f"nullif(CAST({c} AS VARCHAR), '')"
SQL["chunk_metadata"] = "SELECT vec_id, " + ", ".join(f"coalesce({_FILLED(c)}, metadata['{c}']) AS {a}" for c, a in (("novel_id", "m_novel"), ("chapter_index", "m_index"))) + ", metadata['site'] AS m_site, CAST(coalesce(cardinality(metadata), 0) + " + " + ".join(
    f"CASE WHEN {_FILLED(c)} IS NOT NULL AND NOT coalesce(map_contains(metadata, '{c}'), false) THEN 1 ELSE 0 END" for c in _RESERVED
) + " AS INTEGER) AS n FROM chunks"

_LINE = lambda *fields: "concat_ws('|', " + ", ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields) + ")"
SQL["novel_hierarchy"] = f"""{ALL}, r_ AS (SELECT c.chapter_index, c.chapter_id, c.title, coalesce(s.summary, '') AS summary FROM chapters_ c LEFT JOIN first_ s ON s.novel_id = c.novel_id AND s.chapter_id = c.chapter_id WHERE c.novel_id = '{NOVEL}' AND c.chapter_index BETWEEN 1 AND 6)
SELECT novel_id, title, coalesce(summary, '') AS overall_summary, (SELECT count(*) FROM chapters_ c WHERE c.novel_id = n.novel_id) AS chapter_count, CAST(NULL AS VARCHAR) AS warning,
  (SELECT string_agg({_LINE('plot_index', 'volume_title', 'start_chapter', 'end_chapter', 'p.summary')}, chr(10) ORDER BY plot_index) FROM plots_ p WHERE p.novel_id = n.novel_id) AS plots,
  (SELECT string_agg({_LINE('chapter_index', 'chapter_id', 'r.title', 'r.summary')}, chr(10) ORDER BY chapter_index, chapter_id, r.title NULLS FIRST, r.summary) FROM r_ r) AS chapters
FROM novels_ n WHERE novel_id = '{NOVEL}'"""

# ---- chapters out of documents

_START = "^(第.{1,10}章|Chapter [0-9]+)"
_SPLIT = rf"""l_ AS (SELECT raw_id, novel_id, line_no, line, sum(CASE WHEN regexp_matches(line, '{_START}') THEN 1 ELSE 0 END) OVER (PARTITION BY raw_id ORDER BY line_no) AS part,
    bool_or(regexp_matches(line, '{_START}')) OVER (PARTITION BY raw_id) AS has FROM (SELECT raw_id, novel_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT raw_id, novel_id, string_split(content, chr(10)) AS l FROM d_ WHERE parts IS NULL AND content IS NOT NULL))),
txt_ AS (SELECT raw_id, any_value(novel_id) AS novel_id, CAST(CASE WHEN has THEN part - 1 ELSE 0 END AS INTEGER) AS chapter_index, CASE WHEN has THEN {strip(f"regexp_extract(first(line ORDER BY line_no), '{_START}')")} ELSE '' END AS title, {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS content
  FROM l_ WHERE part > 0 OR NOT has GROUP BY raw_id, has, part)"""
_COVERS = quoted(["封面", "目录", "扉页", "前言", "序", "序章", "引子", "楔子"])
_PARTS_SQL = f"""t_ AS (SELECT raw_id, novel_id, list_transform(list_filter(coalesce(toc, []), lambda x: x <> ''), lambda x: {strip('x')}) AS t, parts AS p FROM d_ WHERE parts IS NOT NULL),
u_ AS (SELECT raw_id, novel_id, p, CASE WHEN len(t) > 0 AND t[1] IN ({_COVERS}) AND (len(t) = len(p) + 1 OR len(p) > 0 AND NOT contains(substring(coalesce(p[1], ''), 1, 200), t[1]) AND (coalesce(contains(substring(coalesce(p[1], ''), 1, 200), t[2]), false) OR len(t) > len(p))) THEN t[2:] ELSE t END AS t FROM t_),
epub_ AS (SELECT raw_id, novel_id, CAST(i AS INTEGER) AS chapter_index, coalesce(t[i + 1], 'Chapter ' || (i + 1)) AS title, coalesce(p[i + 1], '') AS content FROM (SELECT *, unnest(range(greatest(len(t), len(p)))) AS i FROM u_))"""
_STEM = r"regexp_extract(file_path, '([^/]*?)(\.[^./]*)?$', 1)"
_DOCS = rf"d_ AS (SELECT *, regexp_replace(regexp_replace(lower(coalesce(nullif(title, ''), {_STEM})), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS novel_id FROM raw_documents)"
_ID = "printf('ch_%04d', chapter_index) AS chapter_id"
SQL["txt_chapters"] = f"WITH {_DOCS}, {_SPLIT} SELECT raw_id, chapter_index, {_ID}, title, content FROM txt_"
SQL["epub_chapters"] = f"WITH {_DOCS}, {_PARTS_SQL} SELECT raw_id, chapter_index, {_ID}, title, content FROM epub_"
SQL["segmented_documents"] = f"WITH {_DOCS}, {_SPLIT}, {_PARTS_SQL} SELECT raw_id, novel_id, chapter_index, {_ID} FROM txt_ UNION ALL SELECT raw_id, novel_id, chapter_index, {_ID} FROM epub_"

# ---- model's answers

_VALUE = lambda j, k: f"json_extract({j}, '$.{k}')"
_TEXT = lambda j: f"json_extract_string({j}, '$')"


def _of_key(k: str) -> str:
    v = _VALUE("j", k)
    nested = "coalesce(" + ", ".join(f"nullif({strip(f"coalesce({_TEXT(_VALUE(v, n))}, '')")}, '')" for n in ("summary", "answer", "content")) + ")"
    items = f"nullif(array_to_string(list_filter(list_transform(CAST({v} AS JSON[]), lambda x: {strip(_TEXT('x'))}), lambda x: x <> ''), chr(10)), '')"
    return f"CASE json_type({v}) WHEN 'OBJECT' THEN {nested} WHEN 'ARRAY' THEN {items} ELSE nullif({strip(f"coalesce({_TEXT(v)}, '')")}, '') END"


SQL["json_summaries"] = rf"""WITH e AS (SELECT state_id, unnest(map_keys(segment_results)) AS segment_no, unnest(map_values(segment_results)) AS v FROM chapter_task_states),
s AS (SELECT state_id, segment_no, {strip('v')} AS t, regexp_extract({strip('v')}, '(?s)\{{.*\}}') AS inner_ FROM e WHERE v IS NOT NULL),
p AS (SELECT state_id, segment_no, t, CASE WHEN t <> '' AND json_valid(t) THEN CAST(t AS JSON) WHEN inner_ <> '' AND json_valid(inner_) THEN CAST(inner_ AS JSON) END AS j FROM s)
SELECT state_id, segment_no, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN t ELSE coalesce({", ".join(_of_key(k) for k in ("summary", "answer", "content", "raw"))}, '') END AS summary FROM p"""

# ---- compositions


def _paragraph_hits(q: str, k: int, source: str = "paragraphs_") -> str:
    return f"SELECT novel_id, chapter_id, chapter_index, chapter_title, paragraph_index, {kw('text', q)} AS score, substring(text, 1, 300) AS snippet FROM {source} WHERE score > 0 ORDER BY score DESC, novel_id, chapter_index NULLS FIRST, chapter_id, paragraph_index LIMIT {k}"


def _recall(queries: list[str], k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT {i} AS query_no, * FROM ({_paragraph_hits(q, k)})" for i, q in enumerate(queries))
    return f"SELECT * EXCLUDE (query_no) FROM ({parts}) QUALIFY row_number() OVER (PARTITION BY novel_id, chapter_id, paragraph_index ORDER BY query_no) = 1"


def _chapter_search(q: str, k: int, qualified: bool = False) -> str:
    known = "(novel_id, chapter_id) NOT IN (SELECT (novel_id, chapter_id) FROM a)" if qualified else "chapter_id NOT IN (SELECT chapter_id FROM a)"
    return f"""SELECT * FROM (WITH a AS ({_SUMMARY_HITS.format(score=kw('summary', q), k=k)}),
b AS (SELECT novel_id, chapter_id, title AS chapter_title, {kw('content', q)} AS score, substring(content, 1, 300) AS snippet, chapter_index FROM chapters_ WHERE score > 0 AND {known} ORDER BY score DESC, novel_id, chapter_index NULLS FIRST, chapter_id LIMIT {k})
SELECT 1 AS stage, row_number() OVER (ORDER BY score DESC, novel_id, chapter_id, item_pos) AS rank, novel_id, chapter_id, score, snippet FROM a
UNION ALL SELECT 2, row_number() OVER (ORDER BY score DESC, novel_id, chapter_id), novel_id, chapter_id, score, snippet FROM b ORDER BY stage, rank LIMIT {k})"""


_HIT = lambda level, text, chapter="chapter_id", paragraph="NULL": f"'{level}' AS level, novel_id, CAST({chapter} AS VARCHAR) AS chapter_id, CAST({paragraph} AS INTEGER) AS paragraph_index, CAST(score AS DOUBLE) AS score, {text} AS text"
_OVERVIEWS = f"SELECT {_HIT('overview', 'summary', 'NULL')} FROM ({SQL['novel_weighted_keyword']}) ORDER BY score DESC, novel_id LIMIT 3"
_PLOT_HITS = f"SELECT {_HIT('plot', 'summary', 'NULL')} FROM (SELECT * FROM ({SQL['plot_keyword']}) ORDER BY score DESC, novel_id, plot_index LIMIT 5)"


def _comprehensive(recall: list[str]) -> str:
    found = f"f_ AS ({_paragraph_hits(KEYWORD, 10)})" + (f", m_ AS ({_recall(recall, 20)})" if recall else "")
    more = " UNION ALL SELECT 2 AS stage, * FROM m_ WHERE (novel_id, chapter_id, paragraph_index) NOT IN (SELECT (novel_id, chapter_id, paragraph_index) FROM f_)" if recall else ""
    return f"""{ALL}, {paragraphs()}, {found}, p_ AS (SELECT 1 AS stage, * FROM f_{more}),
hits_ AS (SELECT * FROM ({_OVERVIEWS}) UNION ALL SELECT * FROM ({_PLOT_HITS}) UNION ALL SELECT {_HIT('chapter', 'snippet')} FROM (SELECT * FROM ({_chapter_search(KEYWORD, 10)}) ORDER BY stage, rank LIMIT 8)
  UNION ALL SELECT {_HIT('paragraph', 'snippet', paragraph='paragraph_index')} FROM (SELECT * FROM p_ ORDER BY stage, score DESC, novel_id, chapter_index NULLS FIRST, chapter_id, paragraph_index LIMIT 15))"""


SQL["keyword_recall"] = f"{ALL}, {paragraphs()} {_recall([KEYWORD, WORD], 20)}"
SQL["comprehensive_answer"] = f"{_comprehensive([WORD])} SELECT * FROM hits_"
SQL["answer_sufficiency"] = f"{_comprehensive([])}, n_ AS (SELECT level, count(*) AS n FROM hits_ GROUP BY 1) SELECT level, n, CAST(sum(n) OVER () AS BIGINT) AS total, sum(n) OVER () >= 5 AS enough FROM n_"
SQL["answer_context"] = f"""{_comprehensive([])}, o_ AS (SELECT level, text, row_number() OVER (PARTITION BY level ORDER BY score DESC, novel_id, chapter_id NULLS FIRST, paragraph_index NULLS FIRST, text) AS i FROM hits_)
SELECT level, substring(string_agg(i || '. ' || coalesce(text, ''), chr(10) ORDER BY i), 1, 4000) AS text FROM o_ GROUP BY level"""
SQL["rewritten_answer"] = f"""{ALL}, {paragraphs()}, r_ AS ({_recall([KEYWORD, WORD], 5)}),
c_ AS (SELECT novel_id, chapter_id, score, snippet FROM ({_chapter_search(KEYWORD, 5, True)} UNION ALL {_chapter_search(WORD, 5, True)}) QUALIFY row_number() OVER (PARTITION BY novel_id, chapter_id ORDER BY score DESC, snippet DESC NULLS LAST) = 1)
SELECT {_HIT('paragraph', 'snippet', paragraph='paragraph_index')} FROM (SELECT * FROM r_ ORDER BY score DESC, novel_id, chapter_id, paragraph_index LIMIT 15)
UNION ALL SELECT {_HIT('chapter', 'snippet')} FROM (SELECT * FROM c_ ORDER BY score DESC, novel_id, chapter_id LIMIT 10)"""
SQL["hierarchical_answer"] = f"""{ALL}, {paragraphs()}, tp_ AS (SELECT novel_id AS n_, plot_index AS i_ FROM ({SQL['plot_keyword']}) ORDER BY score DESC, novel_id, plot_index LIMIT 5),
rg_ AS (SELECT g.* FROM ({SQL['plot_ranges']}) g JOIN tp_ ON n_ = g.novel_id AND i_ = g.plot_index),
w_ AS (SELECT DISTINCT c.novel_id, c.chapter_id FROM chapters_ c JOIN rg_ g ON g.novel_id = c.novel_id WHERE c.chapter_index BETWEEN first_index AND last_index),
s_ AS (SELECT *, {kw('summary')} AS score FROM last_ WHERE (novel_id, chapter_id) IN (SELECT (novel_id, chapter_id) FROM w_) AND length(summary) > 0 AND score > 0 ORDER BY score DESC, novel_id, chapter_id, item_pos LIMIT 10),
wp_ AS (SELECT * FROM paragraphs_ WHERE (novel_id, chapter_id) IN (SELECT (novel_id, chapter_id) FROM w_))
SELECT * FROM ({_OVERVIEWS}) UNION ALL SELECT * FROM ({_PLOT_HITS}) UNION ALL SELECT {_HIT('chapter', 'substring(summary, 1, 300)')} FROM s_ UNION ALL SELECT {_HIT('paragraph', 'snippet', paragraph='paragraph_index')} FROM ({_paragraph_hits(KEYWORD, 15, 'wp_')})"""

# ---- failures and summaries


def _failed(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '(?i){p.replace(chr(92) + 's', WS)}')" for p in patterns) + ")"


def _failure_patterns() -> tuple[list[str], list[str]]:
    from tomeflow.functions.text import FAILURE_PATTERNS, INVALID_PATTERNS

    return FAILURE_PATTERNS, INVALID_PATTERNS


_FAILURES, _INVALID = _failure_patterns()
SQL["audit_defaults"] = f"""WITH t AS (SELECT state_id, unnest(map_keys(segment_results)) AS segment_no, unnest(map_values(segment_results)) AS summary FROM chapter_task_states
  UNION ALL SELECT state_id, unnest(map_keys(segment_errors)), unnest(map_values(segment_errors)) FROM chapter_task_states),
a AS (SELECT state_id, segment_no, length({_NORM}) < 20 AS short, {_failed('summary', _FAILURES)} AS failed, {_RUN} AS run FROM t WHERE {NOT_BLANK('summary')})
SELECT state_id, segment_no, CAST(round(CASE WHEN short THEN 0.45 ELSE 0 END + CASE WHEN failed THEN 0.9 ELSE 0 END + CASE WHEN run THEN 0.3 ELSE 0 END, 3) AS DOUBLE) AS score,
  concat_ws('|', CASE WHEN short THEN 'too_short<20' END, CASE WHEN failed THEN 'matches_failure_pattern' END, CASE WHEN run THEN 'repeated_chars' END) AS why FROM a WHERE short OR failed OR run"""
_CLEAN = lambda c: f"CASE WHEN {_failed(f'lower({strip(c)})', _INVALID)} THEN '' ELSE {strip(c)} END"
SQL["map_reduce_summaries"] = f"""WITH seg_ AS (SELECT * FROM ({SQL['segment_pack']})), told_ AS (SELECT novel_id, chapter_id, segment_index, {_CLEAN('substring(text, 1, 120)')} AS t FROM seg_),
whole_ AS (SELECT novel_id, chapter_id, coalesce(string_agg(t, chr(10) ORDER BY segment_index) FILTER (t <> ''), '') AS t FROM told_ GROUP BY 1, 2), {CHAPTERS}
SELECT c.novel_id, c.chapter_id, coalesce({_CLEAN('substring(w.t, 1, 120)')}, '') AS summary, false AS had_error FROM chapters_ c LEFT JOIN whole_ w ON w.novel_id = c.novel_id AND w.chapter_id = c.chapter_id"""
SQL["until_fit_summaries"] = f"{ALL} SELECT novel_id, chapter_id, {NOT_BLANK('content')} AS told, true AS fits, false AS had_error FROM chapters_"
