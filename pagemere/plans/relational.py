"""Catalogue, notes, lists, gaps and projects as SQL over the overlay; one text runs on Spark and on the oracle.

Where the dialects part, ``OTHER`` has the oracle's own text.
"""

from __future__ import annotations

SQL = {
    "f1_optional_filters": "SELECT chunk_id, work_id, lang FROM chunk WHERE lang = 'en' AND section_type IS DISTINCT FROM 'front' AND work_id IN ('src0', 'src3', 'src9')",
    "f2_reviewed_notes": "SELECT id, kind FROM reviewed_note",
    "f3_dossier_exclusion": "SELECT id, tag FROM note WHERE NOT rejected AND NOT (coalesce(tag, '') = 'dossier' AND NOT reviewed)",
    "f4_proposals_queue": "SELECT id, origin FROM note WHERE NOT reviewed AND NOT rejected AND coalesce(tag, '') <> 'dossier' ORDER BY id DESC",
    "f5_rejected": "SELECT id FROM note WHERE rejected",
    "f6_unattributed": "SELECT id, kind FROM note WHERE attribution IS NULL AND NOT rejected AND kind IN ('claim', 'ficha', 'synthesis', 'question')",
    "f7_claims_by_first_page": "SELECT c.id, a.first_page FROM note c LEFT JOIN (SELECT note_id, min(printed_page) AS first_page FROM anchor GROUP BY note_id) a ON a.note_id = c.id WHERE c.kind = 'claim' AND c.tag = 'dossier' AND NOT c.rejected AND c.reviewed ORDER BY a.first_page NULLS LAST, c.id",
    "f8_substring_notes": "SELECT id FROM note WHERE lower(body) LIKE '%ther%' UNION SELECT note_id FROM anchor WHERE lower(quote) LIKE '%ther%'",
    "f11_workbench_filters": "SELECT id FROM work WHERE priority >= 4 AND path IS NOT NULL AND (lower(title) LIKE '%src%' OR id LIKE '%src%')",
    "f13_untagged": "SELECT id FROM note WHERE tag IS NULL",
    "f15_unverified_works": "SELECT id FROM work WHERE offset_problem IS NOT NULL AND basis IS DISTINCT FROM 'hand_set'",
    "f16_internal_notes": "SELECT id, internal_notes FROM work WHERE nullif(trim(internal_notes), '') IS NOT NULL",
    "f17_unchecked_offsets": "SELECT w.id FROM work w WHERE NOT w.offset_checked AND w.offset_problem IS NULL AND EXISTS (SELECT 1 FROM page p WHERE p.work_id = w.id)",
    "f18_works_without_source": "SELECT id FROM work WHERE path IS NULL AND container_id IS NULL",
    "f19_problem_partition": "SELECT id, CASE WHEN accepted THEN 'accepted' WHEN offset_problem LIKE '%ranges%' THEN 'ranges needed' ELSE 'no numbers' END AS part FROM work WHERE offset_problem IS NOT NULL",
    "f21_list_code_prefix": "SELECT code FROM (SELECT concat(lower(l.name), '.', lower(coalesce(s.letter, 'supl'))) AS code FROM list_section s JOIN list l ON l.id = s.list_id) c WHERE code = 'asia' OR substr(code, 1, 5) = 'asia.'",
    "j2_chunk_work": "SELECT c.chunk_id, w.title FROM chunk c JOIN work w ON w.id = c.work_id",
    "j3_examinable_works": "SELECT id FROM examinable_work",
    "j4_flags": "SELECT w.id, EXISTS (SELECT 1 FROM page p WHERE p.work_id = w.id) AS has_pages, EXISTS (SELECT 1 FROM chunk c WHERE c.work_id = w.id AND c.embedded) AS searchable FROM work w",
    "j5_unsupported_claims": "SELECT n.id FROM note n WHERE n.attribution = 'author' AND NOT n.rejected AND NOT EXISTS (SELECT 1 FROM anchor a WHERE a.note_id = n.id AND a.quote <> '')",
    "j6_open_questions": "SELECT q.id FROM note q WHERE q.kind = 'question' AND NOT q.rejected AND NOT EXISTS (SELECT 1 FROM note_link l WHERE l.to_note = q.id AND l.kind = 'answers')",
    "j7_axis_works": "SELECT a.id AS axis_id, p.id AS part_id, nw.work_id, nw.role FROM note a JOIN note p ON p.parent_id = a.id JOIN note_work nw ON nw.note_id = p.id WHERE a.kind = 'axis'",
    "j8_work_container": "SELECT w.id, c.title AS container_title FROM work w LEFT JOIN work c ON c.id = w.container_id",
    "j9_first_list": "SELECT work_id, name FROM (SELECT i.work_id, l.name, row_number() OVER (PARTITION BY i.work_id ORDER BY l.sort, l.id) AS r FROM list_item i JOIN list l ON l.id = i.list_id) x WHERE r = 1",
    "j10_first_list_or_container": "SELECT id, name FROM (SELECT m.id, l.name, row_number() OVER (PARTITION BY m.id ORDER BY l.sort) AS r FROM (SELECT w.id, i.list_id FROM work w JOIN list_item i ON i.work_id = w.id UNION SELECT w.id, i.list_id FROM work w JOIN list_item i ON i.work_id = w.container_id) m JOIN list l ON l.id = m.list_id) x WHERE r = 1",
    "j11_page_bounds": "SELECT w.id, b.first_printed, b.last_printed FROM work w LEFT JOIN (SELECT work_id, min(CASE WHEN printed_page >= 1 THEN printed_page END) AS first_printed, max(printed_page) AS last_printed FROM printed GROUP BY work_id) b ON b.work_id = w.id",
    "j12_project_full_join": """SELECT coalesce(a.project_id, d.project_id) AS project_id, coalesce(a.work_id, d.work_id) AS work_id, a.work_id IS NOT NULL AS added, d.work_id IS NOT NULL AS from_notes
      FROM project_work a FULL OUTER JOIN (SELECT DISTINCT p.project_id, t.work_id FROM project_note p JOIN reviewed_note n ON n.id = p.note_id JOIN touch t ON t.note_id = n.id) d ON d.project_id = a.project_id AND d.work_id = a.work_id""",
    "j13_volume_expansion": "SELECT i.id, s.id AS member FROM work i JOIN work s ON s.id = i.id UNION SELECT i.id, s.id FROM work i JOIN work s ON s.container_id = i.id",
    "j16_join_using": "SELECT lang, avg_page, n FROM (SELECT lang, round(avg(start_page), 6) AS avg_page FROM chunk GROUP BY lang) a JOIN (SELECT lang, count(*) AS n FROM chunk GROUP BY lang) b USING (lang)",
    "j17_links_either_way": "SELECT from_note AS note_id, to_note AS other, 'out' AS direction, kind FROM note_link UNION ALL SELECT to_note, from_note, 'in', kind FROM note_link",
    "j18_section_at_page": "SELECT work_id, page_index, ordinal FROM (SELECT p.work_id, p.page_index, s.ordinal, row_number() OVER (PARTITION BY p.work_id, p.page_index ORDER BY s.first_page DESC, s.ordinal) AS r FROM printed p JOIN section s ON s.work_id = p.work_id AND p.printed_page BETWEEN s.first_page AND s.last_page) x WHERE r = 1",
    "j19_claim_chapters": """WITH many AS (SELECT work_id FROM section WHERE level = 1 GROUP BY work_id HAVING count(*) >= 2)
      SELECT a.note_id, a.printed_page, CASE WHEN m.work_id IS NULL THEN concat('band ', CAST(CAST(floor((a.printed_page - 1) / 30.0) AS INT) AS VARCHAR(9))) WHEN s.ordinal IS NULL THEN 'before first' ELSE concat('section ', CAST(s.ordinal AS VARCHAR(9))) END AS bucket
      FROM anchor a LEFT JOIN many m ON m.work_id = a.work_id LEFT JOIN (SELECT x.note_id, max(y.ordinal) AS ordinal FROM anchor x JOIN section y ON y.work_id = x.work_id AND y.level = 1 AND y.first_page <= x.printed_page GROUP BY x.note_id) s ON s.note_id = a.note_id WHERE a.printed_page IS NOT NULL""",
    "j20_project_notes": "SELECT n.id FROM note n WHERE n.id IN (SELECT note_id FROM project_note WHERE project_id = 2 UNION SELECT c.id FROM note c JOIN project_note p ON p.note_id = c.parent_id WHERE p.project_id = 2)",
    "j22_citation_containers": "SELECT w.id, coalesce(c.publisher, w.publisher) AS publisher, coalesce(c.year, w.year) AS year FROM work w LEFT JOIN work c ON w.container_id = c.id",
    "a1_conditional_counts": "SELECT count(*) AS total, count(CASE WHEN reviewed THEN 1 END) AS reviewed, count(CASE WHEN rejected THEN 1 END) AS rejected, count(CASE WHEN NOT reviewed AND NOT rejected THEN 1 END) AS pending, count(CASE WHEN tag = 'dossier' THEN 1 END) AS dossier FROM note",
    "a2_notes_per_work": "SELECT w.id, coalesce(t.n, 0) AS n_notes FROM work w LEFT JOIN (SELECT t.work_id, count(DISTINCT t.note_id) AS n FROM touch t JOIN note n ON n.id = t.note_id WHERE NOT n.rejected GROUP BY t.work_id) t ON t.work_id = w.id",
    "a3_connections": "SELECT note_id, count(DISTINCT work_id) AS works FROM touch GROUP BY note_id HAVING count(DISTINCT work_id) > 1",
    "a4_tag_histogram": "SELECT tag, count(*) AS n FROM note WHERE tag IS NOT NULL GROUP BY tag ORDER BY n DESC, tag",
    "a5_edge_grade": "SELECT p.parent_id AS axis_id, nw.work_id, bool_or(nw.role = 'ficha') AS strong FROM note p JOIN note_work nw ON nw.note_id = p.id WHERE p.parent_id IS NOT NULL GROUP BY p.parent_id, nw.work_id",
    "a6_tri_state": "SELECT w.id, CASE WHEN count(n.id) = 0 THEN NULL WHEN bool_and(n.reviewed) THEN 'reviewed' ELSE 'draft' END AS state FROM work w LEFT JOIN note_work nw ON nw.work_id = w.id AND nw.role = 'ficha' LEFT JOIN note n ON n.id = nw.note_id GROUP BY w.id",
    "a7_page_bounds": "SELECT work_id, min(printed_page) AS first_page, max(printed_page) AS last_page, count(*) AS pages FROM printed GROUP BY work_id",
    "a8_neighbouring_pages": "SELECT work_id, printed_page, lag(printed_page) OVER (PARTITION BY work_id ORDER BY printed_page) AS before, lead(printed_page) OVER (PARTITION BY work_id ORDER BY printed_page) AS after FROM (SELECT DISTINCT work_id, printed_page FROM printed) x",
    "a9_offset_looks_wrong": "SELECT work_id, count(folio) AS folios, count(CASE WHEN folio <> printed_page THEN 1 END) AS differing, count(folio) >= 20 AND count(CASE WHEN folio <> printed_page THEN 1 END) > 0.2 * count(folio) AS wrong FROM printed GROUP BY work_id",
    "a12_offset_runs": "SELECT work_id, folio - page_index AS implied, min(page_index) AS first_page, max(page_index) AS last_page, count(*) AS n FROM page WHERE folio IS NOT NULL GROUP BY work_id, folio - page_index HAVING count(*) > 5",
    "a13_islands": """WITH m AS (SELECT work_id, page_index, folio - page_index AS implied, CASE WHEN lag(folio - page_index) OVER (PARTITION BY work_id ORDER BY page_index) = folio - page_index THEN 0 ELSE 1 END AS new FROM page WHERE folio IS NOT NULL),
      g AS (SELECT work_id, page_index, implied, sum(new) OVER (PARTITION BY work_id ORDER BY page_index) AS run FROM m) SELECT work_id, CAST(run AS BIGINT) AS run, implied, min(page_index) AS first_page, max(page_index) AS last_page FROM g GROUP BY work_id, run, implied""",
    "a14_modal_offset": """SELECT work_id, implied, n, round(CAST(n AS DOUBLE) / total, 6) AS share FROM (SELECT work_id, implied, n, sum(n) OVER (PARTITION BY work_id) AS total, row_number() OVER (PARTITION BY work_id ORDER BY n DESC, seen) AS r
      FROM (SELECT work_id, folio - page_index AS implied, count(*) AS n, min(page_index) AS seen FROM page WHERE folio IS NOT NULL GROUP BY work_id, folio - page_index) x) y WHERE r = 1""",
    "a15_state_tally": "SELECT count(CASE WHEN path IS NULL THEN 1 END) AS no_file, count(CASE WHEN offset_problem IS NOT NULL THEN 1 END) AS problem, count(CASE WHEN accepted THEN 1 END) AS accepted FROM work",
    "a17_health_counts": "SELECT (SELECT count(*) FROM work) AS works, (SELECT count(*) FROM page) AS pages, (SELECT count(*) FROM chunk WHERE NOT embedded) AS unembedded, (SELECT count(*) FROM note WHERE NOT reviewed AND NOT rejected) AS pending",
    "a18_coverage": "SELECT count(DISTINCT CASE WHEN c.embedded THEN e.id END) AS searchable, count(DISTINCT e.id) AS examinable FROM examinable_work e LEFT JOIN chunk c ON c.work_id = e.id",
    "a20_group_min": "SELECT work_id, min(start_page) AS first_page, min(chunk_id) AS first_chunk, min(lang) AS lang FROM chunk GROUP BY work_id",
    "a23_touched_sets": "SELECT work_id, max(CASE WHEN quoted THEN 1 ELSE 0 END) = 1 AS quoted FROM (SELECT work_id, quote <> '' AS quoted FROM anchor UNION ALL SELECT work_id, CAST(NULL AS BOOLEAN) FROM note_work) x GROUP BY work_id",
    "a24_axis_counts": "SELECT a.id, coalesce(f.n, 0) AS fichas, coalesce(w.n, 0) AS works FROM note a LEFT JOIN (SELECT parent_id, count(*) AS n FROM note WHERE kind = 'ficha' AND NOT rejected GROUP BY parent_id) f ON f.parent_id = a.id LEFT JOIN (SELECT p.parent_id, count(DISTINCT nw.work_id) AS n FROM note p JOIN note_work nw ON nw.note_id = p.id GROUP BY p.parent_id) w ON w.parent_id = a.id WHERE a.kind = 'axis'",
    "a25_project_counts": "SELECT p.id, coalesce(w.n, 0) AS works, coalesce(k.n, 0) AS notes FROM project p LEFT JOIN (SELECT project_id, count(*) AS n FROM project_work GROUP BY project_id) w ON w.project_id = p.id LEFT JOIN (SELECT project_id, count(*) AS n FROM project_note GROUP BY project_id) k ON k.project_id = p.id",
    "a27_folio_evidence": "SELECT p.work_id, count(*) AS pages, count(p.folio) AS with_folio FROM page p JOIN work w ON w.id = p.work_id WHERE w.offset_problem IS NOT NULL GROUP BY p.work_id",
    "t3_duplicate_choice": "SELECT work_id, printed_page, page_index FROM (SELECT work_id, printed_page, page_index, row_number() OVER (PARTITION BY work_id, printed_page ORDER BY CASE WHEN folio = printed_page THEN 0 WHEN folio IS NULL THEN 2 ELSE 1 END, page_index DESC) AS r FROM printed) x WHERE r = 1",
    "t5_keyset_page": "SELECT id, row_number() OVER (ORDER BY id DESC) <= 50 AS shown FROM (SELECT id FROM note WHERE id < 5000 ORDER BY id DESC LIMIT 51) x",
    "t6_printed_order": "SELECT i.list_id, row_number() OVER (PARTITION BY i.list_id ORDER BY s.sort NULLS LAST, i.ordinal NULLS LAST, coalesce(w.author, w.title), w.id) AS nth, w.id FROM list_item i JOIN list l ON l.id = i.list_id LEFT JOIN list_section s ON s.id = i.section_id JOIN work w ON w.id = i.work_id",
    "t9_top_per_group": "SELECT work_id, chunk_id, r FROM (SELECT work_id, chunk_id, row_number() OVER (PARTITION BY work_id ORDER BY start_page DESC, chunk_id) AS r FROM chunk) x WHERE r <= 5",
    "t10_next_ordinal": "SELECT parent_id, coalesce(max(turn), 0) + 1 AS next_ordinal FROM note WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "t11_work_queue": "SELECT w.id FROM work w WHERE w.path IS NOT NULL AND NOT w.offset_checked AND EXISTS (SELECT 1 FROM page p WHERE p.work_id = w.id) ORDER BY w.n LIMIT 5",
    "t12_rating_sort": "SELECT id, coalesce(priority, -1) AS stars, row_number() OVER (PARTITION BY coalesce(priority, -1) ORDER BY n) AS nth FROM work",
    "u1_union_edges": "SELECT note_id, work_id FROM touch",
    "u2_union_all_padding": "SELECT note_id, work_id, quote FROM anchor UNION ALL SELECT note_id, work_id, CAST(NULL AS VARCHAR(99)) FROM note_work",
    "u4_set_difference": "SELECT id FROM work EXCEPT SELECT work_id FROM note_work",
    "c1_file_state": "SELECT w.id, CASE WHEN w.path IS NULL THEN 'no_pdf' WHEN p.work_id IS NULL THEN 'held' WHEN w.offset_problem IS NOT NULL AND NOT w.accepted THEN 'blocked' WHEN c.work_id IS NOT NULL THEN 'searchable' ELSE 'loaded' END AS state FROM work w LEFT JOIN (SELECT DISTINCT work_id FROM page) p ON p.work_id = w.id LEFT JOIN (SELECT DISTINCT work_id FROM chunk WHERE embedded) c ON c.work_id = w.id WHERE w.container_id IS NULL",
    "c4_page_verified": "SELECT p.work_id, p.printed_page, CASE WHEN w.offset_problem IS NOT NULL AND w.basis IS DISTINCT FROM 'hand_set' THEN 'no' WHEN w.basis = 'hand_set' THEN 'hand set' ELSE 'yes' END AS verified, concat(CAST(p.printed_page AS VARCHAR(9)), CASE WHEN w.offset_problem IS NOT NULL AND w.basis IS DISTINCT FROM 'hand_set' THEN '*' ELSE '' END) AS label FROM printed p JOIN work w ON w.id = p.work_id",
    "c5_page_status": "SELECT work_id, page_index, CASE WHEN printed_page < 1 THEN 'front matter' WHEN folio IS NULL THEN 'computed' WHEN folio = printed_page THEN 'printed' ELSE 'warning' END AS status FROM printed",
    "c10_analysis_state": "SELECT w.id, count(CASE WHEN n.reviewed THEN 1 END) AS accepted, count(CASE WHEN NOT n.reviewed AND NOT n.rejected THEN 1 END) AS pending, count(CASE WHEN n.rejected THEN 1 END) AS rejected FROM work w LEFT JOIN anchor a ON a.work_id = w.id LEFT JOIN note n ON n.id = a.note_id AND n.kind = 'claim' GROUP BY w.id",
    "c11_provenance": "SELECT id, CASE WHEN attribution = 'author' THEN 'the author' WHEN attribution = 'own' THEN 'mine' WHEN attribution = 'other' THEN 'another' ELSE 'not stated' END AS whose, CASE WHEN reviewed THEN 'reviewed' ELSE 'proposed' END AS provenance FROM note",
    "snk2_section_load": "SELECT work_id, ordinal, first_page, coalesce(lead(first_page) OVER (PARTITION BY work_id ORDER BY ordinal) - 1, last_page) AS last_page FROM section WHERE first_page >= 1",
    "snk3_chunk_load": "SELECT chunk_id, work_id, CASE WHEN start_page < 1 THEN 'front' END AS section_type FROM chunk",
    "snk4_pending_embeddings": "SELECT chunk_id FROM chunk WHERE NOT embedded ORDER BY chunk_id",
    "snk7_fill_blank_only": "SELECT w.id, coalesce(nullif(w.publisher, ''), c.publisher) AS publisher, coalesce(w.year, c.year) AS year FROM work w LEFT JOIN work c ON c.id = w.container_id",
    "r2_volume_contents": "SELECT container_id, id, row_number() OVER (PARTITION BY container_id ORDER BY first_page NULLS LAST, id) AS nth FROM work WHERE container_id IS NOT NULL",
    "r4_memberships": "SELECT i.work_id, l.name, s.letter FROM list_item i JOIN list l ON l.id = i.list_id LEFT JOIN list_section s ON s.id = i.section_id",
    "r8_notes_for_work": "SELECT n.id, t.work_id FROM note n JOIN touch t ON t.note_id = n.id WHERE NOT n.rejected AND NOT (coalesce(n.tag, '') = 'dossier' AND NOT n.reviewed)",
    "r10_axis_tree": "SELECT a.id AS axis_id, count(CASE WHEN p.kind = 'ficha' THEN 1 END) AS fichas, count(CASE WHEN p.kind = 'synthesis' THEN 1 END) AS syntheses FROM note a LEFT JOIN note p ON p.parent_id = a.id WHERE a.kind = 'axis' GROUP BY a.id",
    "r12_works_in_no_axis": "SELECT w.id FROM work w WHERE NOT EXISTS (SELECT 1 FROM note p JOIN note_work nw ON nw.note_id = p.id WHERE p.parent_id IS NOT NULL AND nw.work_id = w.id)",
    "r15_readiness": "SELECT v.id, count(DISTINCT n.id) AS notes, max(CASE WHEN a.quote <> '' THEN 1 ELSE 0 END) = 1 AS quoted FROM (SELECT id, id AS member FROM work UNION SELECT container_id, id FROM work WHERE container_id IS NOT NULL) v LEFT JOIN touch t ON t.work_id = v.member LEFT JOIN reviewed_note n ON n.id = t.note_id LEFT JOIN anchor a ON a.note_id = n.id AND a.work_id = v.member GROUP BY v.id",
    "r16_list_pivot": "SELECT i.list_id, coalesce(CAST(i.section_id AS VARCHAR(9)), 'loose') AS section, count(*) AS works FROM list_item i GROUP BY i.list_id, i.section_id",
    "r21_sections": "SELECT work_id, ordinal, level, first_page, last_page FROM section ORDER BY work_id, ordinal",
    "w10_cascade_delete": "SELECT a.note_id, a.ordinal FROM anchor a WHERE NOT EXISTS (SELECT 1 FROM note n WHERE n.id = a.note_id AND n.rejected)",
    "d3_verdict_batches": "SELECT id, n, CAST(floor((row_number() OVER (PARTITION BY n ORDER BY id) - 1) / 20.0) AS BIGINT) AS batch FROM note WHERE kind = 'claim'",
    "h1_order_revenue": "SELECT o.o_orderpriority AS priority, count(DISTINCT o.o_orderkey) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority",
    "h2_customers_without_orders": "SELECT c.c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority LIKE '1%')",
    "h3_latest_order": "SELECT c_custkey, o_orderkey FROM (SELECT c.c_custkey, o.o_orderkey, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey) AS r FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey) x WHERE r = 1",
    "a16_events_per_local_day": "SELECT CAST(to_date(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'America/Denver')) AS STRING) AS day, count(*) AS n FROM {events} GROUP BY 1",
    "a11_mode_language": "SELECT work_id, mode(lang, true) AS lang FROM chunk GROUP BY work_id",
    "a19_median_chars": "SELECT source, CAST(median(n_chars) AS DOUBLE) AS chars FROM {documents} GROUP BY source",
    "fmt10_tags": "SELECT conv_id, turn, array_join(array_distinct(transform(split(concat('Owl, night,', lower(role), ', owl'), ','), x -> lower(trim(x)))), ';') AS tags FROM {conversations}",
    "fmt8_percent": "SELECT n_chars, concat('close (', CAST(CAST(bround((n_chars % 400) * 100.0 / 400, 0) AS INT) AS STRING), '%)') AS label FROM {documents}",
}

OTHER = {
    "a16_events_per_local_day": "SELECT CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS DATE) AS VARCHAR) AS day, count(*) AS n FROM {events} GROUP BY 1",
    "a11_mode_language": "SELECT work_id, mode() WITHIN GROUP (ORDER BY lang) AS lang FROM chunk GROUP BY work_id",
    "fmt10_tags": "SELECT conv_id, turn, CASE WHEN lower(role) IN ('owl', 'night') THEN 'owl;night' ELSE concat('owl;night;', lower(role)) END AS tags FROM {conversations}",
    "fmt8_percent": "SELECT n_chars, concat('close (', CAST(CAST(round_even((n_chars % 400) * 100.0 / 400, 0) AS INT) AS VARCHAR), '%)') AS label FROM {documents}",
}
