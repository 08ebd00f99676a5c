"""DuckDB's SQL of tables drawn in text, shared by the queries that find and rewrite them."""

from __future__ import annotations

#: Needs `lines` of doc_id, line_no, line, liked. Gives `found` (a row a table, with its content) and `spans` (with its markdown).
FOUND = r"""p AS (SELECT *, last_value(CASE WHEN liked THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, trim(coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '')) = '' AS blank FROM lines
), i AS (SELECT *, sum(CASE WHEN liked AND (prev IS NULL OR line_no - prev > 2 OR (line_no - prev = 2 AND blank)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM p
), g AS (SELECT doc_id, island, min(line_no) AS first_line, max(CASE WHEN liked THEN line_no END) AS last_line FROM i WHERE island > 0 GROUP BY ALL
), member AS (SELECT i.doc_id, i.island, i.line_no, i.line, i.liked, g.last_line FROM i JOIN g USING (doc_id, island) WHERE i.line_no <= g.last_line
), starts AS (SELECT doc_id, island, last_line, line_no AS start FROM member WHERE liked AND last_line - line_no >= 2
), tails AS (SELECT s.doc_id, s.island, s.last_line, s.start, m.line_no, m.line FROM starts s JOIN member m USING (doc_id, island) WHERE m.line_no >= s.start
), v(ch, k) AS (VALUES ('|', 0), ('│', 1), ('┃', 2), ('┆', 3), ('┇', 4), ('┊', 5), ('┋', 6)
), seps AS (SELECT doc_id, island, start, ch AS sep FROM (SELECT doc_id, island, start, ch, k, sum(length(line) - length(replace(line, ch, ''))) AS n FROM tails, v GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, island, start ORDER BY n DESC, k) = 1
), raw AS (SELECT t.*, sep, list_transform(string_split(line, sep), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS c, trim(line) = '' OR regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[─━═_┌┐└┘╔╗╚╝╭╮╰╯├┤┬┴┼╠╣╦╩╬ -]+$') AS drawn FROM tails t JOIN seps USING (doc_id, island, start)
), opened AS (SELECT *, CASE WHEN c[1] = '' THEN list_slice(c, 2, len(c)) ELSE c END AS o FROM raw
), celled AS (SELECT *, CASE WHEN drawn THEN [] WHEN len(o) > 0 AND o[len(o)] = '' THEN list_slice(o, 1, len(o) - 1) ELSE o END AS cells FROM opened
), sizes AS (SELECT doc_id, island, start, len(cells) AS n, count(*) AS k FROM celled WHERE len(cells) > 0 GROUP BY ALL
), usual AS (SELECT * FROM sizes QUALIFY row_number() OVER (PARTITION BY doc_id, island, start ORDER BY k DESC, n) = 1
), parsed AS (SELECT doc_id, island, last_line, start, sep, count(*) FILTER (len(cells) > 0) AS n_rows, sum(length(line)) AS chars, sum(length(line) - length(replace(line, sep, ''))) AS marks, list(cells ORDER BY line_no) FILTER (len(cells) > 0) AS content FROM celled GROUP BY ALL
), scored AS (SELECT p.*, least(CAST(1 AS DOUBLE), u.k / n_rows * CAST(0.4 AS DOUBLE) + CASE WHEN chars > 0 THEN least(CAST(1 AS DOUBLE), marks / (chars * CAST(0.1 AS DOUBLE))) ELSE 0 END * CAST(0.3 AS DOUBLE) + CASE WHEN u.n >= 2 THEN 1 ELSE 0 END * CAST(0.3 AS DOUBLE)) AS confidence FROM parsed p JOIN usual u USING (doc_id, island, start) WHERE n_rows >= 2
), best AS (SELECT * FROM scored WHERE confidence >= CAST(0.6 AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY doc_id, island ORDER BY start) = 1
), found AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS "table", start, last_line AS "end", n_rows AS rows, list_max(list_transform(content, lambda r: len(r))) AS cols, sep AS separator, confidence, content FROM best
)"""


def markdown(content: str) -> str:
    """A table's content as markdown."""
    row = f"lambda r: '| ' || array_to_string(list_slice(list_concat(r, list_transform(range(cols), lambda z: '')), 1, cols), ' | ') || ' |'"
    return f"""array_to_string(list_concat(list_concat(list_slice(list_transform({content}, {row}), 1, 1), ['| ' || array_to_string(list_transform(range(cols), lambda z: '---'), ' | ') || ' |']), list_slice(list_transform({content}, {row}), 2, rows)), chr(10))"""


def spaced(text: str) -> str:
    """The spacing rules."""
    return rf"regexp_replace(regexp_replace(regexp_replace({text}, ' +', ' ', 'g'), ' +([.,;:!?])', '\1', 'g'), '([.,;:!?])([A-Za-z])', '\1 \2', 'g')"
