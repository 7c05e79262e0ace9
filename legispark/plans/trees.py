"""Queries: the tree of every document, what it counts, what is wrong with it, and its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legispark.operators import structure, tree
from legispark.plans.base import query
from legispark.plans.texts import KINDS, LAW_SQL, law

_EVENTS = "('part', 'chapter', 'section', 'article', 'appendix', 'signature', 'table')"
_BOXES = ("appendix", "part", "chapter", "section")
_PREFIX = {
    "part": r"(?i)^PHẦN\s+((THỨ\s+\S+)|[IVXLCDM]+|\d+[A-ZĐ]?)",
    "chapter": r"(?i)^CHƯƠNG\s+([IVXLCDM]+|\d+[A-ZĐ]?)",
    "section": r"(?i)^(MỤC\s+([IVXLCDM]+|\d+[A-ZĐ]?)|[IVXLCDM]+[.)]\s+)",
    "article": r"(?i)^ĐIỀU\s+\d+[A-ZĐ]?",
    "appendix": r"(?i)^(PHỤ\s+LỤC(\s+[IVXLCDM\d]+)?|MẪU\s+SỐ\s+\S+)",
}
_TITLE = "regexp_replace(substr(line, length(CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(line, '{p}')" for k, p in _PREFIX.items()) + " END) + 1), '^[ \\t.:\\-–—]+|[ \\t.:\\-–—]+$', '', 'g')"
_NAME = structure.TITLE_BLOCKERS.replace("(?iuU)", "(?i)")
_LOOSE = f"(k NOT IN {_EVENTS} AND k IN ('text', 'free_heading') AND length(line) <= 180 AND len(regexp_split_to_array(line, '\\s+')) <= 18 AND NOT regexp_matches(line, '{_NAME}') AND NOT regexp_matches(line, '[.;?!]$'))"
_TIGHT = f"({_LOOSE} AND NOT regexp_matches(line, '[,;]') AND len(regexp_split_to_array(line, '\\s+')) <= 14)"
_RUN = "(PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = "(PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _open(level: str) -> str:
    """What is open at a line, as id and label; 0 once it is closed."""
    own = f"(k = '{level}' AND NOT taken)" + (" OR inferred" if level == "appendix" else "")
    closes = ", ".join(f"'{x}'" for x in ("signature", *_BOXES[: _BOXES.index(level)]))
    return f"last_value(CASE WHEN {own} THEN {{id: line_no, label: CASE WHEN inferred THEN line ELSE coalesce(nullif(label, ''), line) END}} WHEN k IN ({closes}) THEN {{id: 0, label: ''}} END IGNORE NULLS) OVER r AS {level}_"


TREE = f"""toks AS (SELECT doc_id, line_no, trim(l, ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS l, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM {LAW_SQL} law)) WHERE trim(l, ' ' || chr(9) || chr(13)) <> ''),
kinds AS {KINDS.split('kinds AS', 1)[1]},
t1 AS (SELECT *, CASE WHEN kind IN ('part', 'chapter', 'section', 'article', 'appendix') THEN {_TITLE} END AS title, count(*) FILTER (WHERE kind = 'table_end') OVER {_BEFORE} AS t FROM lab),
t2 AS (SELECT *, min(CASE WHEN kind = 'table_start' THEN line_no END) OVER (PARTITION BY doc_id, t) AS s FROM t1),
t3 AS (SELECT *, CASE WHEN line_no >= s THEN s END AS table_id, CASE WHEN s = line_no THEN 'table' WHEN line_no > s THEN 'in_table' ELSE kind END AS k FROM t2),
t4 AS (SELECT *, {_LOOSE} AS loose, last_value(CASE WHEN k IN {_EVENTS} THEN k END IGNORE NULLS) OVER {_RUN} AS last_, last_value(CASE WHEN k IN ('signature', 'appendix') THEN k END IGNORE NULLS) OVER {_BEFORE} AS closed, count(*) FILTER (WHERE k IN ('signature', 'appendix')) OVER {_RUN} AS part_no,
  (lag(k) OVER o IN ('part', 'chapter', 'section', 'appendix') AND lag(title) OVER o = '' AND {_LOOSE}) OR (lag(k) OVER o = 'article' AND lag(title) OVER o = '' AND {_TIGHT}) AS named, bool_or(k IN {_EVENTS}) OVER (PARTITION BY doc_id) AS structured FROM t3 WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
t5 AS (SELECT *, coalesce(k = 'free_heading' AND regexp_matches(line, '(?i)^(DANH\\s+MỤC|BẢNG|BIỂU)(\\s|$)') AND NOT coalesce(named, false) AND last_ <> 'article' AND closed = 'signature', false) AS fits FROM t4),
t6 AS (SELECT *, fits AND count(*) FILTER (WHERE fits) OVER (PARTITION BY doc_id, part_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS inferred FROM t5),
t7 AS (SELECT *, (coalesce(named, false) OR (coalesce(lag(inferred) OVER (PARTITION BY doc_id ORDER BY line_no), false) AND loose)) AND NOT inferred AS taken FROM t6),
t8 AS (SELECT *, {", ".join(map(_open, _BOXES))}, CASE WHEN k = 'article' OR (last_ = 'article' AND k NOT IN {_EVENTS} AND k <> 'in_table') THEN last_value(CASE WHEN k = 'article' THEN line_no END IGNORE NULLS) OVER r END AS article FROM t7 WINDOW r AS {_RUN}),
t9 AS (SELECT *, {", ".join(f"nullif({c}_.id, 0) AS {c}" for c in _BOXES)}, concat_ws('/', {", ".join(f"CASE WHEN {c}_.id > 0 THEN '{c}=' || {c}_.label END" for c in _BOXES)}) AS path,
  last_value(CASE WHEN NOT taken AND k = 'numbered_item' THEN line_no END IGNORE NULLS) OVER w AS clause, last_value(CASE WHEN NOT taken AND k IN ('numbered_item', 'lettered_item') THEN line_no END IGNORE NULLS) OVER w AS item, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS previous,
  structured AND last_ IS NULL AS preface FROM t8 WINDOW w AS (PARTITION BY doc_id, article ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t10 AS (SELECT *, CASE WHEN table_id IS NOT NULL THEN table_id WHEN preface THEN min(CASE WHEN preface THEN line_no END) OVER (PARTITION BY doc_id) WHEN taken THEN previous WHEN article IS NOT NULL THEN coalesce(item, article) ELSE line_no END AS owner FROM t9),
t11 AS (SELECT *, CASE WHEN owner = line_no THEN CASE WHEN preface THEN 'preamble' WHEN inferred THEN 'appendix' WHEN k IN ('part', 'chapter', 'section', 'appendix', 'article', 'table') THEN k WHEN k = 'signature' THEN 'heading' WHEN article IS NOT NULL THEN CASE k WHEN 'numbered_item' THEN 'clause' ELSE 'point' END
  WHEN k = 'free_heading' THEN 'heading' WHEN k IN ('numbered_item', 'lettered_item', 'bullet') THEN 'list_item' ELSE 'paragraph' END END AS type,
  coalesce((appendix < coalesce(part, chapter, section, line_no))::INT, 0) AS outer_ FROM t10),
t12 AS (SELECT *, CASE WHEN k = 'signature' OR type IN ('preamble', 'appendix') THEN NULL WHEN type = 'point' THEN coalesce(clause, article) WHEN type = 'clause' THEN article WHEN type = 'part' THEN appendix WHEN type = 'chapter' THEN coalesce(part, appendix) WHEN type = 'section' THEN coalesce(chapter, part, appendix) ELSE coalesce(section, chapter, part, appendix) END AS parent,
  CASE WHEN k = 'signature' OR type IN ('preamble', 'appendix') THEN 1 WHEN type = 'part' THEN 1 + outer_ WHEN type = 'chapter' THEN 1 + outer_ + (part IS NOT NULL)::INT WHEN type = 'section' THEN 1 + outer_ + (part IS NOT NULL)::INT + (chapter IS NOT NULL)::INT
  ELSE 1 + outer_ + (part IS NOT NULL)::INT + (chapter IS NOT NULL)::INT + (section IS NOT NULL)::INT + CASE type WHEN 'clause' THEN 1 WHEN 'point' THEN 1 + (clause IS NOT NULL)::INT ELSE 0 END END AS level,
  CASE WHEN inferred THEN line WHEN type IN ('part', 'chapter', 'section', 'appendix') THEN coalesce(nullif(label, ''), line) WHEN type = 'article' THEN label WHEN type = 'clause' THEN regexp_extract(line, '(?i)^(\\d{{1,3}}[a-zđ]?)[.)]', 1) WHEN type = 'point' THEN regexp_extract(line, '(?i)^([a-zđ]\\d*)[.)]', 1)
  WHEN type = 'list_item' THEN CASE WHEN k = 'bullet' THEN '-' ELSE regexp_extract(line, '(?i)^(\\d{{1,3}}[a-zđ]?[.)]|[a-zđ]\\d*[.)])', 1) END END AS name,
  CASE WHEN taken OR k = 'in_table' OR type IN ('part', 'chapter', 'section', 'appendix', 'article', 'table') THEN NULL WHEN type IN ('clause', 'point') OR (type = 'list_item' AND k <> 'bullet') THEN regexp_replace(line, '(?i)^(\\d{{1,3}}[a-zđ]?|[a-zđ]\\d*)[.)]\\s*', '') WHEN type = 'list_item' THEN regexp_replace(line, '^[-–—•▪▫◦‣⁃∙]\\s*', '') ELSE line END AS said FROM t11),
tree AS (SELECT doc_id, owner AS node_id, max(CASE WHEN type IS NOT NULL THEN parent END) AS parent_id, max(CASE WHEN type IS NOT NULL THEN level END)::INT AS level, max(type) AS type, max(CASE WHEN type IS NOT NULL THEN name END) AS label,
  CASE WHEN max(type) IN ('part', 'chapter', 'section', 'appendix', 'article') THEN coalesce(max(CASE WHEN taken THEN line END), max(CASE WHEN type IS NOT NULL AND NOT inferred THEN title END), '') END AS title, max(CASE WHEN taken THEN line END) IS NOT NULL AS title_inferred,
  max(CASE WHEN type IS NOT NULL THEN path END) AS path, coalesce(string_agg(nullif(trim(said), ''), chr(10) ORDER BY line_no), '') AS text, max(line_no) AS line_end FROM t12 GROUP BY doc_id, owner)"""


@query(f"WITH {TREE} SELECT * FROM tree")
def document_tree(spark: SparkSession, d: str) -> DataFrame:
    return tree.document_tree(law(spark, d)).select("doc_id", "node_id", "parent_id", "level", "type", "label", "title", "title_inferred", "path", "text", "line_end")


_COUNTS = {"parts": "part", "chapters": "chapter", "sections": "section", "articles": "article", "clauses": "clause", "points": "point", "appendices": "appendix", "headings": "heading", "paragraphs": "paragraph", "list_items": "list_item", "tables": "table"}


@query(f"""WITH {TREE}, n AS (SELECT law.doc_id, coalesce(max(CASE WHEN type = 'preamble' THEN tree.text END), '') AS preamble, count(type) AS nodes, {", ".join(f"count(*) FILTER (WHERE type = '{v}') AS {k}" for k, v in _COUNTS.items())} FROM {LAW_SQL} law LEFT JOIN tree USING (doc_id) GROUP BY law.doc_id)
SELECT * EXCLUDE (nodes), CASE WHEN nodes = 0 THEN 'empty' WHEN articles > 0 AND parts + chapters + sections > 0 THEN CASE WHEN appendices > 0 THEN 'mixed_hierarchical' ELSE 'hierarchical_article_based' END WHEN articles > 0 THEN CASE WHEN appendices > 0 THEN 'mixed_article_appendix' ELSE 'article_based' END
WHEN appendices > 0 THEN 'appendix_or_form' WHEN parts + chapters + sections > 0 THEN 'hierarchical_no_articles' WHEN headings + list_items + tables > 0 THEN 'semi_structured' ELSE 'free_form' END AS structure_type, CASE WHEN nodes = 0 THEN 'skipped_no_text' ELSE 'ok' END AS parser_status FROM n""")
def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    """A row per document, also for those without text."""
    return tree.parsed(law(spark, d)).select("doc_id", "preamble", *_COUNTS, "structure_type", "parser_status")


WARNED = f"""{TREE}, a AS (SELECT doc_id, node_id, label, path FROM tree WHERE type = 'article'), cl AS (SELECT t.doc_id, t.node_id, t.label, a.label AS article, a.node_id AS article_id FROM tree t JOIN a ON a.doc_id = t.doc_id AND a.node_id = t.parent_id WHERE t.type = 'clause'),
pt AS (SELECT doc_id, parent_id, label FROM tree WHERE type = 'point'),
warned AS (SELECT doc_id, article_id AS node_id, 'duplicate_clause_number:article=' || article AS warning FROM cl GROUP BY 1, 2, article HAVING count(DISTINCT lower(label)) < count(*)
UNION ALL SELECT a.doc_id, a.node_id, 'duplicate_direct_point_number:article=' || a.label FROM a JOIN pt ON pt.doc_id = a.doc_id AND pt.parent_id = a.node_id GROUP BY a.doc_id, a.node_id, a.label HAVING count(DISTINCT lower(pt.label)) < count(*)
UNION ALL SELECT cl.doc_id, cl.node_id, 'duplicate_point_number:article=' || article || ',clause=' || cl.label FROM cl JOIN pt ON pt.doc_id = cl.doc_id AND pt.parent_id = cl.node_id GROUP BY cl.doc_id, cl.node_id, article, cl.label HAVING count(DISTINCT lower(pt.label)) < count(*)
UNION ALL SELECT doc_id, node_id, 'article_without_body:' || label FROM tree t WHERE type = 'article' AND text = '' AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.doc_id = t.doc_id AND c.parent_id = t.node_id)
UNION ALL SELECT doc_id, min(node_id), 'duplicate_article_number:article=' || lower(label) || ',count=' || count(*) || ',path=' || path FROM a GROUP BY doc_id, path, lower(label) HAVING count(*) > 1
UNION ALL SELECT doc_id, table_id, CASE WHEN kind IN ('table_headers', 'table_row') THEN 'invalid_table_row:' ELSE 'unexpected_table_line:' END || line_no FROM t3 WHERE k = 'in_table' AND kind <> 'table_end'
  AND (kind NOT IN ('table_headers', 'table_row') OR NOT json_valid(substr(line, CASE kind WHEN 'table_headers' THEN 18 ELSE 14 END)))
UNION ALL SELECT doc_id, table_id, 'unterminated_table:' || table_id FROM t3 WHERE table_id IS NOT NULL GROUP BY doc_id, table_id HAVING NOT bool_or(kind = 'table_end'))"""


@query(f"WITH {WARNED} SELECT doc_id, node_id, warning FROM warned")
def tree_warnings(spark: SparkSession, d: str) -> DataFrame:
    return tree.tree_warnings(law(spark, d)).select("doc_id", "node_id", "warning")


@query(f"""WITH {WARNED}, w AS (SELECT doc_id, count(*) AS told FROM warned GROUP BY 1),
x AS (SELECT law.doc_id, length(law.text) AS size, coalesce(max(CASE WHEN type = 'preamble' THEN length(tree.text) END), 0) AS preamble, coalesce(max(CASE WHEN type NOT IN ('preamble', 'clause', 'point') THEN length(tree.text) END), 0) AS largest, coalesce(max(CASE WHEN type = 'article' THEN length(tree.text) END), 0) AS article FROM {LAW_SQL} law LEFT JOIN tree USING (doc_id) GROUP BY law.doc_id, law.text),
f AS (SELECT x.doc_id, concat_ws(',', CASE WHEN preamble > 50000 THEN 'severe:oversized_preamble' END, CASE WHEN article > 50000 THEN 'severe:oversized_article_text' END, CASE WHEN size > 5000 AND largest > size * 0.8 THEN 'severe:single_node_dominates_document' END, CASE WHEN told >= 20 THEN 'severe:many_parser_warnings' WHEN told > 0 THEN 'parser_warnings' END) AS flags FROM x LEFT JOIN w USING (doc_id))
SELECT doc_id, flags, CASE WHEN contains(flags, 'severe:') THEN 'quarantine' WHEN flags <> '' THEN 'review' ELSE 'ok' END AS parse_quality FROM f""")
def tree_quality(spark: SparkSession, d: str) -> DataFrame:
    return tree.parsed(law(spark, d)).select("doc_id", F.array_join("quality_flags", ",").alias("flags"), "parse_quality")
