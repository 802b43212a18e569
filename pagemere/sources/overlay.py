"""The engine's relations laid over the given tables, as SQL that Spark and DuckDB both run.

A name in braces is a given table.  ``compose`` puts the relations a text uses before it as common table
expressions; Catalyst inlines and prunes them.
"""

from __future__ import annotations

import re

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations")

RELATIONS = {
    "src": "SELECT source AS id, CAST(substr(source, 4) AS INT) AS n FROM {documents} WHERE source IS NOT NULL GROUP BY source",
    "work": """SELECT id, n, CASE WHEN n % 5 <> 4 THEN concat('Author', CAST(n % 6 AS VARCHAR(9)), ', Given') END AS author,
      concat('The Title of ', id) AS title, CASE WHEN n % 3 <> 1 THEN 'Press' END AS publisher, CASE WHEN n % 7 <> 2 THEN 'Town' END AS place,
      CASE WHEN n % 6 <> 5 THEN 1950 + n END AS year, CASE n % 4 WHEN 0 THEN 'edited' WHEN 1 THEN 'essay' WHEN 2 THEN 'monograph' ELSE 'film' END AS kind,
      CASE WHEN n % 4 = 1 THEN concat('src', CAST(n - 1 AS VARCHAR(9))) END AS container_id, CASE WHEN n % 4 = 1 THEN n * 10 END AS first_page,
      n % 7 - 3 AS page_offset, CASE WHEN n % 6 > 0 THEN n % 6 END AS priority, CASE WHEN n % 8 <> 7 THEN concat(id, '.pdf') END AS path,
      CASE WHEN n % 3 = 0 THEN 'no numbers' WHEN n % 9 = 4 THEN 'enter ranges' END AS offset_problem, n % 3 = 1 AS offset_checked, n % 6 = 0 AS accepted,
      CASE n % 4 WHEN 0 THEN 'hand_set' WHEN 1 THEN 'none_printed' END AS basis, CASE n % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'see index' END AS internal_notes,
      CASE WHEN n % 5 = 3 THEN 'https://example.org' END AS url, CASE WHEN n % 10 = 3 THEN '2024-05-01' END AS accessed,
      CASE WHEN n % 10 = 4 THEN 'Ed, Itor' END AS editor, CASE WHEN n % 7 = 3 THEN 'waits for OCR' END AS verdict FROM src""",
    "work_state": "SELECT id, CASE n % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'optional' END AS standing, CASE n % 5 WHEN 0 THEN 'held' WHEN 1 THEN 'wanted' WHEN 2 THEN 'none' END AS pdf_state FROM src",
    "page": """SELECT p.work_id, p.page_index, p.lang, p.chunk_id, p.text, CASE WHEN p.page_index % 5 = 0 THEN NULL WHEN p.page_index % 11 = 0 THEN p.page_index + w.page_offset + 3
      ELSE p.page_index + w.page_offset END AS folio FROM (SELECT source AS work_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_index, lang, doc_id AS chunk_id, text
      FROM {documents} WHERE source IS NOT NULL) p JOIN work w ON w.id = p.work_id""",
    "scan": """SELECT work_id, page_index, concat(CASE WHEN page_index % 3 > 0 THEN concat('Of the ', CASE CAST(floor((page_index - 1) / 15.0) AS INT) % 5 WHEN 0 THEN 'Owls' WHEN 1 THEN 'Rivers' WHEN 2 THEN 'Stones' WHEN 3 THEN 'Nights' ELSE 'Towns' END)
      ELSE concat('The Book ', coalesce(CAST(folio AS VARCHAR(9)), '')) END, chr(10), text, chr(10), CASE WHEN page_index % 4 = 3 THEN coalesce(CAST(folio AS VARCHAR(9)), '') ELSE '' END) AS text FROM page WHERE text IS NOT NULL""",
    "page_range": "SELECT id AS work_id, 5 AS from_page, 10 AS to_page, page_offset + 2 AS page_offset FROM work WHERE n % 4 = 2",
    "printed": """SELECT p.work_id, p.page_index, p.lang, p.chunk_id, p.folio, p.page_index + coalesce(r.page_offset, w.page_offset) AS printed_page FROM page p JOIN work w ON w.id = p.work_id
      LEFT JOIN page_range r ON r.work_id = p.work_id AND p.page_index BETWEEN r.from_page AND r.to_page""",
    "chunk": """SELECT p.chunk_id, p.work_id, p.lang, p.printed_page AS start_page, CASE WHEN p.printed_page < 1 THEN 'front' END AS section_type, e.vec_id IS NOT NULL AS embedded
      FROM printed p LEFT JOIN {embeddings} e ON e.vec_id = p.chunk_id""",
    "note": """SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 AND conv_id % 3 = 0 THEN conv_id * 100 END AS parent_id,
      CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'axis' WHEN (conv_id + turn) % 4 = 0 THEN 'claim' WHEN (conv_id + turn) % 4 = 1 THEN 'ficha' WHEN (conv_id + turn) % 4 = 2 THEN 'question' ELSE 'synthesis' END AS kind,
      CASE (conv_id + turn) % 4 WHEN 0 THEN 'author' WHEN 1 THEN 'own' WHEN 2 THEN 'other' END AS attribution,
      CASE WHEN conv_id % 5 = 0 THEN 'dossier' WHEN conv_id % 5 = 1 THEN 'owls' WHEN conv_id % 5 = 2 THEN 'night' END AS tag,
      role AS origin, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN concat('Axis ', CAST(conv_id AS VARCHAR(20))) END AS title, text AS body, turn % 2 = 0 AS reviewed, conv_id % 7 = 3 AND turn % 5 = 4 AS rejected, CAST(conv_id % 20 AS INT) AS n, CAST(turn AS INT) AS turn FROM {conversations}""",
    "note_work": "SELECT id AS note_id, concat('src', CAST(n AS VARCHAR(9))) AS work_id, CASE WHEN turn % 2 = 0 THEN 'ficha' ELSE 'about' END AS role FROM note WHERE kind <> 'question'",
    "anchor": """SELECT id AS note_id, 1 AS ordinal, concat('src', CAST((n + turn) % 20 AS VARCHAR(9))) AS work_id, CASE WHEN turn % 3 > 0 THEN turn * 7 + 1 END AS printed_page,
      CASE WHEN turn % 4 = 0 THEN '' WHEN turn % 4 > 1 THEN substr(body, 1, 30) END AS quote FROM note WHERE kind IN ('claim', 'ficha')""",
    "note_link": "SELECT id AS from_note, id - 1 AS to_note, CASE WHEN turn % 3 = 0 THEN 'bridge' ELSE 'answers' END AS kind FROM note WHERE turn > 0 AND n % 2 = 0",
    "list": "SELECT CAST(r_regionkey AS INT) AS id, r_name AS name, CAST(r_regionkey AS INT) AS sort, r_regionkey % 2 = 0 AS examinable, CASE r_regionkey WHEN 0 THEN 'theory' WHEN 1 THEN 'dissertation' WHEN 2 THEN 'teaching' ELSE lower(r_name) END AS list_key FROM {region}",
    "list_section": "SELECT CAST(n_nationkey AS INT) AS id, CAST(n_regionkey AS INT) AS list_id, CASE WHEN n_nationkey % 3 > 0 THEN substr(n_name, 1, 1) END AS letter, CASE WHEN n_nationkey % 4 = 0 THEN 'supplementary' ELSE 'core' END AS kind, CASE WHEN n_nationkey % 4 = 0 THEN 'Supplementary' ELSE n_name END AS title, CAST(n_nationkey AS INT) AS sort FROM {nation}",
    "list_item": """SELECT w.n % 5 AS list_id, w.id AS work_id, s.id AS section_id, CASE WHEN w.n % 7 > 0 THEN w.n END AS ordinal FROM work w
      LEFT JOIN (SELECT list_id, min(id) AS id FROM list_section GROUP BY list_id) s ON s.list_id = w.n % 5 AND w.n % 3 > 0 WHERE w.n % 4 <> 1
      UNION ALL SELECT (n + 1) % 5, id, CAST(NULL AS INT), n FROM work WHERE n % 6 = 2""",
    "section": "SELECT w.id AS work_id, o.o AS ordinal, 1 + o.o % 2 AS level, (o.o - 1) * 12 + 1 AS first_page, o.o * 12 - 2 AS last_page FROM work w CROSS JOIN (SELECT CAST(r_regionkey AS INT) + 1 AS o FROM {region}) o WHERE w.n % 3 < 2",
    "project": "SELECT CAST(r_regionkey AS INT) AS id, r_name AS name FROM {region}",
    "project_work": "SELECT n % 5 AS project_id, id AS work_id FROM work WHERE n % 2 = 0",
    "project_note": "SELECT CAST(n % 5 AS INT) AS project_id, id AS note_id FROM note WHERE turn = 0",
    "reviewed_note": "SELECT * FROM note WHERE reviewed AND NOT rejected",
    "touch": "SELECT note_id, work_id FROM note_work UNION SELECT note_id, work_id FROM anchor",
    "examinable_work": """SELECT w.id FROM work w WHERE w.id IN (SELECT i.work_id FROM list_item i JOIN list l ON l.id = i.list_id WHERE l.examinable)
      UNION SELECT w.id FROM work w JOIN list_item i ON i.work_id = w.container_id JOIN list l ON l.id = i.list_id WHERE l.examinable""",
}


#: ``page`` for Spark where its texts are read: works are numbered on their keys, so that no task is sent a work's texts.
#: Rows of one doc_id of a work, should there be some, are told apart among themselves.
EVEN_PAGE = RELATIONS["page"].replace(
    """(SELECT source AS work_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_index, lang, doc_id AS chunk_id, text
      FROM {documents} WHERE source IS NOT NULL) p""",
    """(SELECT d.source AS work_id, CAST(k.before + d.nth AS INT) AS page_index, d.lang, d.doc_id AS chunk_id, d.text FROM
      (SELECT source, doc_id, lang, text, doc_id IS NULL AS none, coalesce(doc_id, 0) AS id, row_number() OVER (PARTITION BY source, doc_id IS NULL, coalesce(doc_id, 0) ORDER BY doc_id) AS nth FROM {documents} WHERE source IS NOT NULL) d
      JOIN (SELECT source, doc_id IS NULL AS none, coalesce(doc_id, 0) AS id, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS before FROM (SELECT source, doc_id, count(*) AS n FROM {documents} WHERE source IS NOT NULL GROUP BY source, doc_id) c) k
      ON k.source = d.source AND k.none = d.none AND k.id = d.id) p""",
)


def _uses(text: str) -> set[str]:
    return {n for n in RELATIONS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)}


def compose(text: str, relations: dict[str, str] = RELATIONS) -> str:
    """The text with the relations it uses, in order of need."""
    done: list[str] = []

    def need(t: str) -> None:
        for n in sorted(_uses(t)):
            if n not in done:
                need(relations[n])
                done.append(n)

    need(text)
    parts = ", ".join(f"{n} AS ({relations[n]})" for n in done)
    own = re.match(r"\s*WITH\s+", text)
    if own:
        return f"WITH {parts}{', ' if parts else ''}{text[own.end() :]}"
    return f"WITH {parts} {text}" if parts else text


def spark_sql(text: str, sf_dir: str) -> str:
    texts = re.search(r"\btext\b", text) or ("*" in text and _uses(text) & {"page", "scan"})
    whole = compose(text, RELATIONS | {"page": EVEN_PAGE} if texts else RELATIONS)
    return re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", whole)


def duck_sql(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", compose(text))
