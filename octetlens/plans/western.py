"""DuckDB's SQL for the two Western charsets: text outside of tags, and its pairs of classes."""

from __future__ import annotations

from ..operators.classes import class_model, latin1_classes, macroman_classes


def western_sql(source: str) -> str:
    """CTEs ``stripped`` (id, t), ``latin1`` and ``macroman`` (id, bad, c) of a table (id, b) of bytes as characters."""
    model = class_model()
    latin, mac = latin1_classes(), macroman_classes()
    rows = ", ".join(f"({b}, {int(latin[b])}, {int(mac[b])})" for b in range(256))
    values = ", ".join(f"({a}, {b}, {int(model[a][b])})" for a in range(9) for b in range(9))
    ends = "\n".join(
        f""", {name} AS (SELECT n.id, bad = 1 AS bad, CASE WHEN bad = 1 THEN 0.01e0 WHEN bad IS NULL THEN 0e0 ELSE greatest((f3 - f1 * 20e0) / (f1 + f2 + f3), 0e0) * 0.73e0 END AS c FROM (
  SELECT {source}.id, max((v = 0)::INT) AS bad, sum((v = 1)::INT)::DOUBLE AS f1, sum((v = 2)::INT)::DOUBLE + {prior}e0 AS f2, sum((v = 3)::INT)::DOUBLE AS f3
  FROM {source} LEFT JOIN (classes JOIN mdl ON mdl.a = {name}_before AND mdl.b = {name}_class) USING (id) GROUP BY {source}.id) n)"""
        for name, prior in (("latin1", 0), ("macroman", 10))
    )
    return f"""cls(b, l, m) AS (VALUES {rows}), mdl(a, b, v) AS (VALUES {values}),
cuts AS (SELECT id, string_split(b, '<') AS parts FROM {source}),
inside AS (SELECT id, parts, list_transform(parts, lambda x: CASE WHEN contains(x, '>') THEN substr(x, length(x) - position('>' IN reverse(x)) + 2) END) AS i FROM cuts),
stripped AS (SELECT id, CASE WHEN len(parts) = 1 THEN coalesce(i[1], parts[1]) ELSE
  (CASE WHEN coalesce(i[1], parts[1]) <> '' THEN coalesce(i[1], parts[1]) || ' ' ELSE '' END)
  || array_to_string(list_transform(list_filter(i[2:len(parts) - 1], lambda x: x <> ''), lambda x: x || ' '), '') || coalesce(i[len(parts)], '') END AS t FROM inside),
shown AS (SELECT id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS place FROM stripped WHERE t <> ''),
coded AS (SELECT id, place, l, m FROM shown JOIN cls ON cls.b = ascii(ch)),
classes AS (SELECT id, l AS latin1_class, m AS macroman_class, coalesce(lag(l) OVER w, 1) AS latin1_before, coalesce(lag(m) OVER w, 1) AS macroman_before FROM coded WINDOW w AS (PARTITION BY id ORDER BY place))
{ends}"""
