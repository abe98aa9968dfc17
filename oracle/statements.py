"""DuckDB SQL per registered query, from the event table alone.

Written for plainness, not for speed: the grid is a join of collections and snapshots, windows
run over whole hosts, and counters are counted one snapshot at a time.
"""

from __future__ import annotations

import re

# Common table expressions by name; a statement pulls in those it mentions.
_CTES = {
    # --- the event log read as index counters (FIXTURES.md) ---
    "log": r"""
        SELECT user_id AS u, event_type AS e, value, floor(epoch(ts))::BIGINT AS t,
            CASE WHEN regexp_extract(props, '(\d+)', 1)::INTEGER >= 50 THEN 'k_hi' ELSE 'k_lo' END AS i
        FROM events
    """,
    "days": "SELECT unnest(range(min(t) // 86400, max(t) // 86400 + 1))::INTEGER AS d FROM log",
    "captures": """
        SELECT 1 AS h, d, 36000 AS s FROM days
        UNION ALL SELECT 2, d, (d * 7919) % 86400 FROM days
        UNION ALL SELECT 3, d, 3600 FROM days
        UNION ALL SELECT 3, d, 82800 FROM days WHERE d % 5 = 0
    """,
    "series": """
        SELECT u, e, i, u % 3 + 1 AS h, min(t) AS ft,
            CASE WHEN u % 13 = 0 THEN 'audit_' ELSE '' END || 'c' || u::VARCHAR || '_' || e
                || CASE WHEN u % 17 = 0 THEN '.AnnotationSource.metas' ELSE '' END AS name
        FROM (SELECT u, e, t FROM log), (VALUES ('k_lo'), ('k_hi')) AS ix(i)
        GROUP BY u, e, i
    """,
    "present": """
        SELECT c.*, p.d, p.s, p.d::BIGINT * 86400 + p.s AS instant,
            c.u % 11 = 0 AND p.d >= 19743 AS was_reset
        FROM series c JOIN captures p ON p.h = c.h
        WHERE (c.u % 2 = 0 OR p.d::BIGINT * 86400 + p.s >= c.ft)
            AND NOT (c.u % 5 = 0 AND p.d >= 19738 + c.u % 10)
            AND NOT (c.u % 7 = 0 AND p.d BETWEEN 19733 AND 19735)
    """,
    "items": """
        SELECT 'mongo0' || p.h::VARCHAR AS mongo_hostname, p.d AS days_post_epoch,
            p.s::INTEGER AS seconds_of_day, p.name AS CollectionName, p.i AS IndexName,
            count(l.t)::BIGINT AS UseCount,
            make_timestamp(1000000 * CASE WHEN p.was_reset THEN 19743::BIGINT * 86400
                WHEN p.u % 2 = 0 THEN ((SELECT min(d) FROM days) - 1)::BIGINT * 86400 ELSE p.ft END) AS Since
        FROM present p LEFT JOIN log l
            ON l.u = p.u AND l.e = p.e AND l.i = p.i AND l.value >= 80 AND l.t <= p.instant
            AND (NOT p.was_reset OR l.t >= 19743::BIGINT * 86400)
        GROUP BY p.h, p.d, p.s, p.name, p.i, p.was_reset, p.u, p.ft
    """,
    # --- facts ---
    "facts": """
        SELECT mongo_hostname, days_post_epoch, seconds_of_day, CollectionName,
            sum(UseCount)::BIGINT AS UseCount,
            count(*) FILTER (UseCount > 0) AS ActiveIndexCount, count(*) AS TotalIndexCount
        FROM items GROUP BY ALL
    """,
    "index_facts": """
        SELECT i.mongo_hostname, i.days_post_epoch, i.seconds_of_day, i.IndexName,
            sum(i.UseCount)::BIGINT AS UseCount,
            count(*) FILTER (i.UseCount > 0) AS ActiveInCollectionCount,
            count(*) FILTER (f.ActiveIndexCount > 0) AS LoadedInCollectionCount,
            count(*) AS PresentInCollectionCount
        FROM items i JOIN facts f
            USING (mongo_hostname, days_post_epoch, seconds_of_day, CollectionName)
        GROUP BY i.mongo_hostname, i.days_post_epoch, i.seconds_of_day, i.IndexName
    """,
    "known": """
        SELECT mongo_hostname, CollectionName,
            min(days_post_epoch::BIGINT * 86400 + seconds_of_day) AS KnownAsOfEpoch
        FROM facts GROUP BY mongo_hostname, CollectionName HAVING sum(UseCount) > 0
    """,
    "snaps": "SELECT DISTINCT mongo_hostname, days_post_epoch, seconds_of_day FROM items",
    # --- timeline ---
    "timed": """
        SELECT *, days_post_epoch::BIGINT * 86400 + seconds_of_day AS instant FROM snaps
    """,
    "placed": """
        SELECT mongo_hostname AS host, days_post_epoch AS d, seconds_of_day AS s, instant,
            row_number() OVER w AS rank,
            lag(instant) OVER w AS prior_at, lead(instant) OVER w AS next_at,
            first_value(instant) OVER whole AS first_at, last_value(instant) OVER whole AS last_at
        FROM timed
        WINDOW w AS (PARTITION BY mongo_hostname ORDER BY days_post_epoch, seconds_of_day),
            whole AS (PARTITION BY mongo_hostname ORDER BY days_post_epoch, seconds_of_day
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
    "sequenced": """
        SELECT *, (instant - first_at) // 86400 AS up_rel, (last_at - instant) // 86400 AS down_rel,
            d - first_at // 86400 AS up_abs, last_at // 86400 - d AS down_abs,
            row_number() OVER (PARTITION BY host, (instant - first_at) // 86400 ORDER BY d, s) AS up_rel_seq,
            row_number() OVER (PARTITION BY host, (last_at - instant) // 86400 ORDER BY d DESC, s DESC)
                AS down_rel_seq,
            row_number() OVER (PARTITION BY host, d ORDER BY s) AS up_abs_seq,
            row_number() OVER (PARTITION BY host, d ORDER BY s DESC) AS down_abs_seq
        FROM placed
    """,
    "conflicts": """
        SELECT host, count(*) - count(DISTINCT up_rel) <= count(*) - count(DISTINCT up_abs) AS up_by_rel,
            count(*) - count(DISTINCT down_rel) <= count(*) - count(DISTINCT down_abs) AS down_by_rel
        FROM sequenced GROUP BY host
    """,
    "chosen": """
        SELECT q.*, CASE WHEN up_by_rel THEN up_rel ELSE up_abs END AS up,
            CASE WHEN up_by_rel THEN up_rel_seq ELSE up_abs_seq END AS up_seq,
            CASE WHEN down_by_rel THEN down_rel ELSE down_abs END AS down,
            CASE WHEN down_by_rel THEN down_rel_seq ELSE down_abs_seq END AS down_seq
        FROM sequenced q JOIN conflicts USING (host)
    """,
    "ranges": """
        SELECT host AS mongo_hostname, rank::INTEGER AS partition_rank,
            d AS days_post_epoch, s AS seconds_of_day, {this} AS this_event_at,
            {prior}, {next}, {first}, prior_at IS NULL AS is_first_partition,
            {last}, next_at IS NULL AS is_last_partition,
            up::VARCHAR || CASE WHEN up_seq > 1 THEN '_' || up_seq::VARCHAR ELSE '' END
                AS ascending_label,
            down::VARCHAR || CASE WHEN down_seq > 1 THEN '_' || down_seq::VARCHAR ELSE '' END
                AS descending_label
        FROM chosen
    """,
    # --- collections at snapshots ---
    "grid": """
        SELECT r.mongo_hostname, r.days_post_epoch, r.seconds_of_day,
            r.partition_rank AS PartitionRank, k.CollectionName, k.KnownAsOfEpoch,
            r.days_post_epoch::BIGINT * 86400 + r.seconds_of_day AS instant,
            r.first_days_post::BIGINT * 86400 + r.first_seconds_of AS first_at
        FROM known k JOIN ranges r USING (mongo_hostname)
    """,
    "before_after": """
        SELECT g.mongo_hostname, g.days_post_epoch, g.seconds_of_day, g.PartitionRank,
            g.CollectionName, f.UseCount, f.ActiveIndexCount, f.TotalIndexCount,
            lag(f.UseCount) OVER (PARTITION BY f.mongo_hostname, f.CollectionName
                ORDER BY g.PartitionRank) AS UseCountBefore,
            f.UseCount IS NULL AND g.KnownAsOfEpoch < g.instant AS IsPurgedCollection,
            g.KnownAsOfEpoch > g.first_at AS IsCreatedCollection
        FROM grid g LEFT JOIN facts f ON f.mongo_hostname = g.mongo_hostname
            AND f.days_post_epoch = g.days_post_epoch AND f.seconds_of_day = g.seconds_of_day
            AND f.CollectionName = g.CollectionName
    """,
    "discrete": "SELECT {label_columns}, {current_status} AS CollectionUseStatus FROM before_after",
    "discrete_v1": "SELECT {label_columns}, {v1_status} AS CollectionUseStatus FROM before_after",
    "used": """
        SELECT *, CollectionUseStatus IN ('Current', 'Accessed') AS active,
            CollectionUseStatus IN ('Forgotten', 'Ignored') AS unused
        FROM discrete
    """,
    "policy": "{policy:13 PRECEDING AND CURRENT ROW}",
    "policy_n7": "{policy:6 PRECEDING AND CURRENT ROW}",
    "policy_n4": "{policy:3 PRECEDING AND CURRENT ROW}",
    "policy_v1": "{policy:14 PRECEDING AND 1 PRECEDING}",
    # --- transitions ---
    "steps": """
        SELECT mongo_hostname, PartitionRank AS r, ActivityPolicyStatus AS a,
            lag(ActivityPolicyStatus) OVER w AS b, lag(PartitionRank) OVER w AS br
        FROM policy
        WINDOW w AS (PARTITION BY mongo_hostname, CollectionName ORDER BY PartitionRank)
    """,
    "edges": """
        SELECT mongo_hostname, r, b, a, b || br::VARCHAR AS StateBefore,
            a || r::VARCHAR AS StateAfter, count(*) AS EdgeCount
        FROM steps WHERE b IS NOT NULL GROUP BY mongo_hostname, r, br, b, a
    """,
    # --- legacy ---
    "tracked": """
        SELECT * FROM items
        WHERE NOT starts_with(CollectionName, 'audit')
            AND NOT contains(CollectionName, 'AnnotationSource.metas')
    """,
    "known_legacy": """
        SELECT mongo_hostname, CollectionName, min(Since) AS IsKnownAsOf
        FROM tracked GROUP BY mongo_hostname, CollectionName HAVING sum(UseCount) > 0
    """,
    "first_items": """
        SELECT i.* FROM items i JOIN ranges r
            USING (mongo_hostname, days_post_epoch, seconds_of_day)
        WHERE r.is_first_partition
    """,
    "horizon": """
        SELECT mongo_hostname, max(Since) AS InitialFutureDate FROM first_items GROUP BY ALL
    """,
    "legacy_grid": """
        SELECT r.*, k.CollectionName, k.IsKnownAsOf, f.UseCount,
            lag(f.UseCount) OVER (PARTITION BY f.mongo_hostname, f.CollectionName
                ORDER BY r.partition_rank) AS UseCountBefore,
            f.UseCount IS NULL AND epoch_us(k.IsKnownAsOf)
                < 1000000 * (r.days_post_epoch::BIGINT * 86400 + r.seconds_of_day)
                AS IsPurgedCollection,
            h.InitialFutureDate < k.IsKnownAsOf AS IsCreatedCollection
        FROM known_legacy k JOIN ranges r USING (mongo_hostname)
            JOIN horizon h USING (mongo_hostname)
            LEFT JOIN facts f ON f.mongo_hostname = r.mongo_hostname
                AND f.days_post_epoch = r.days_post_epoch AND f.seconds_of_day = r.seconds_of_day
                AND f.CollectionName = k.CollectionName
    """,
    "legacy_status": """
        SELECT *, partition_rank AS PartitionRank, {v1_status} AS CollectionUseStatus
        FROM legacy_grid
    """,
    "legacy_nav": "{nav:legacy_status}",
    "legacy_labels": """
        SELECT mongo_hostname, CollectionName, ascending_label AS AscendingLabel,
            this_event_at AS ThisEventAt, days_post_epoch, seconds_of_day,
            PartitionRank AS CurrentPartitionRank, prior_event_at AS PriorEventAt,
            UseCountBefore, UseCount, ChangedAtRank, ChangedUseStatusTo, CollectionUseStatus,
            CollectionUseStatusBefore, IsCreatedCollection AS IsFutureCollection,
            IsPurgedCollection, PriorChangeRank, PriorChangeStatus, PriorChangeRankTwo,
            PriorChangeStatusTwo, IsKnownAsOf
        FROM legacy_nav
    """,
    "nav": "{nav:discrete}",
    # --- raw reports ---
    "named": """
        SELECT mongo_hostname, days_post_epoch, seconds_of_day,
            'loadtest.' || CollectionName AS CollectionName,
            '{{ "' || IndexName || '": 1 }}' AS IndexName, UseCount, Since
        FROM items
    """,
    "report": """
        SELECT DISTINCT mongo_hostname, days_post_epoch, seconds_of_day, '' AS c, '' AS i, 0 AS step,
            'index usage' AS line, 0 AS digit FROM named
        UNION ALL
        SELECT DISTINCT mongo_hostname, days_post_epoch, seconds_of_day, CollectionName, '', 1,
            CollectionName || ':', 0 FROM named
        UNION ALL
        SELECT mongo_hostname, days_post_epoch, seconds_of_day, CollectionName, IndexName, 2,
            IndexName, UseCount % 10 FROM named
        UNION ALL
        SELECT mongo_hostname, days_post_epoch, seconds_of_day, CollectionName, IndexName, 3,
            '    node: ops: ' || UseCount::VARCHAR || ', since: '
                || strftime(Since, '%Y-%m-%d %H:%M:%S.%g') || ' +0000 UTC', UseCount % 10
        FROM named
    """,
    "damaged": """
        SELECT * REPLACE (
            CASE WHEN step = 3 AND digit = 9 THEN '    node: ops: n/a' ELSE line END AS line)
        FROM report WHERE NOT (step = 2 AND digit = 4)
    """,
    "damaged_numbered": """
        SELECT *, row_number() OVER w - 1 AS line_no, lag(step) OVER w AS prior_step,
            lag(digit) OVER w AS prior_digit
        FROM damaged
        WINDOW w AS (PARTITION BY mongo_hostname, days_post_epoch, seconds_of_day
            ORDER BY c, i, step)
    """,
    # --- checks ---
    "starts": """
        SELECT mongo_hostname, min(Since) AS PostSince FROM first_items GROUP BY ALL
    """,
}


def _text(at: str) -> str:
    return f"strftime(make_timestamp(1000000 * ({at})::BIGINT), '%Y-%m-%d %H:%M:%S')"


def _neighbour(end: str, span: str, backward: bool) -> str:
    gap = f"(instant - {end}_at)" if backward else f"({end}_at - instant)"
    return (
        f"({end}_at // 86400)::INTEGER AS {end}_days_post, "
        f"({end}_at % 86400)::INTEGER AS {end}_seconds_of, "
        f"({gap} // 86400)::INTEGER AS {span}_days_post, "
        f"({gap} % 86400)::INTEGER AS {span}_seconds_of, {_text(end + '_at')} AS {end}_event_at"
    )


# Status rules, one line per status.
_CURRENT_STATUS = """CASE
    WHEN UseCount IS NULL AND IsCreatedCollection THEN
        CASE WHEN IsPurgedCollection THEN 'Deleted' ELSE 'NotCreated' END
    WHEN UseCount IS NULL THEN CASE WHEN IsPurgedCollection THEN 'Removed' ELSE 'ERROR' END
    WHEN IsCreatedCollection THEN
        CASE sign(UseCount - coalesce(UseCountBefore, -1))
            WHEN 1 THEN 'Current' WHEN 0 THEN 'Forgotten' ELSE 'ERROR' END
    WHEN UseCount = 0 THEN 'NotLoaded'
    ELSE CASE sign(UseCount - UseCountBefore)
        WHEN 1 THEN 'Accessed' WHEN 0 THEN 'Ignored' ELSE 'ERROR' END
    END"""
_V1_STATUS = """CASE
    WHEN UseCount IS NULL AND IsCreatedCollection THEN
        CASE WHEN IsPurgedCollection THEN 'Deleted' ELSE 'NotCreated' END
    WHEN UseCount IS NULL THEN CASE WHEN IsPurgedCollection THEN 'Removed' ELSE 'ERROR' END
    WHEN IsCreatedCollection THEN
        CASE WHEN UseCount > coalesce(UseCountBefore, -1) THEN 'Current'
            WHEN UseCount = UseCountBefore AND UseCount > 0 THEN 'Forgotten' ELSE 'ERROR' END
    WHEN UseCount = 0 THEN 'NotLoaded'
    WHEN UseCount > coalesce(UseCountBefore, 0) THEN 'Accessed'
    WHEN UseCount = UseCountBefore THEN 'Ignored'
    ELSE 'ERROR' END"""
_LABEL_COLUMNS = (
    "mongo_hostname, days_post_epoch, seconds_of_day, PartitionRank, CollectionName, UseCount"
)


def _policy(frame: str) -> str:
    return f"""
        SELECT {_LABEL_COLUMNS}, CollectionUseStatus,
            CASE WHEN active THEN 'Active'
                WHEN CollectionUseStatus = 'Removed' THEN 'Deleted'
                WHEN NOT unused THEN CollectionUseStatus
                WHEN coalesce(bool_or(active) OVER (w ROWS BETWEEN {frame}), false) THEN 'Idle'
                WHEN coalesce(bool_or(active) OVER (w ROWS BETWEEN 1 FOLLOWING
                    AND UNBOUNDED FOLLOWING), false) THEN 'Restorable'
                ELSE 'Inactive' END AS ActivityPolicyStatus
        FROM used
        WINDOW w AS (PARTITION BY mongo_hostname, CollectionName ORDER BY PartitionRank)
    """


def _nav(source: str) -> str:
    """Change navigation; the latest earlier change is found as the greatest earlier rank."""
    return f"""
        SELECT m.* EXCLUDE (changed),
            p.PartitionRank AS PriorChangeRank, p.CollectionUseStatus AS PriorChangeStatus,
            t.PartitionRank AS PriorChangeRankTwo, t.CollectionUseStatus AS PriorChangeStatusTwo
        FROM (
            SELECT *, CASE WHEN changed THEN PartitionRank END AS ChangedAtRank,
                CASE WHEN changed THEN CollectionUseStatus END AS ChangedUseStatusTo,
                max(CASE WHEN changed THEN PartitionRank END) OVER (
                    PARTITION BY mongo_hostname, CollectionName ORDER BY PartitionRank
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS change_rank,
                lag(PartitionRank) OVER (
                    PARTITION BY mongo_hostname, CollectionName, changed ORDER BY PartitionRank
                ) AS same_kind_rank
            FROM (
                SELECT *, CollectionUseStatusBefore IS DISTINCT FROM CollectionUseStatus AS changed
                FROM (
                    SELECT *, lag(CollectionUseStatus) OVER (
                        PARTITION BY mongo_hostname, CollectionName ORDER BY PartitionRank
                    ) AS CollectionUseStatusBefore
                    FROM {source}
                )
            )
        ) m
        LEFT JOIN {source} p ON p.mongo_hostname = m.mongo_hostname
            AND p.CollectionName = m.CollectionName AND p.PartitionRank = m.change_rank
        LEFT JOIN {source} t ON t.mongo_hostname = m.mongo_hostname
            AND t.CollectionName = m.CollectionName AND t.PartitionRank = m.same_kind_rank
    """


def _expand(text: str) -> str:
    """Fill in the shared expressions of a table expression or statement."""
    text = re.sub(r"\{policy:([^}]*)\}", lambda m: _policy(m.group(1)), text)
    text = re.sub(r"\{nav:(\w+)\}", lambda m: _nav(m.group(1)), text)
    shared = {
        "this": _text("instant"),
        "prior": _neighbour("prior", "since_prior", True),
        "next": _neighbour("next", "until_next", False),
        "first": _neighbour("first", "since_first", True),
        "last": _neighbour("last", "until_last", False),
        "current_status": _CURRENT_STATUS,
        "v1_status": _V1_STATUS,
        "label_columns": _LABEL_COLUMNS,
    }
    for name, expression in shared.items():
        text = text.replace("{" + name + "}", expression)
    return text.replace("{{", "{").replace("}}", "}")


def statement(body: str, items_where: str = "true") -> str:
    """``body`` preceded by the table expressions it needs, in their order of definition.
    ``items_where``: the items that there are, for everything that follows from them."""
    body = _expand(body)
    tables = _CTES | {"items": f"SELECT * FROM ({_CTES['items']}) WHERE {items_where}"}
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"\b\w+\b", pending.pop()))
        for name in words & (tables.keys() - needed):
            needed.add(name)
            pending.append(_expand(tables[name]))
    ctes = ",\n".join(f"{name} AS ({_expand(sql)})" for name, sql in tables.items() if name in needed)
    return f"WITH {ctes}\n{body}"


_ITEMS = (
    "SELECT CollectionName, IndexName, UseCount, Since, "
    "mongo_hostname, days_post_epoch, seconds_of_day FROM {source}"
)
_ROW = "StateBefore || ' [' || EdgeCount::VARCHAR || '] ' || StateAfter"
_KEY = "mongo_hostname, days_post_epoch, seconds_of_day"


def _copies(source: str) -> str:
    return (
        f"(SELECT * FROM {source} UNION ALL "
        f"SELECT * FROM {source} WHERE days_post_epoch = 19730 AND UseCount > 0)"
    )


def _duplicates(source: str, key: str) -> str:
    return (
        f"SELECT {_KEY}, {key}, count(*) AS RowCount FROM {_copies(source)} "
        f"GROUP BY {_KEY}, {key} HAVING count(*) > 1"
    )


def _counts(source: str, key: str = _KEY) -> str:
    return f"SELECT {key}, count(*) AS RowCount FROM {source} GROUP BY {key}"


_INSTANT = "days_post_epoch, seconds_of_day"
_ALL_ITEMS = _ITEMS.replace("{source}", "items")
_INDEX_FACTS = "SELECT * FROM index_facts"
_SHIFTED = "SELECT * REPLACE (UseCount + CASE WHEN {where} THEN 7 ELSE 0 END AS UseCount) FROM {source}"


def _shifted(source: str, where: str) -> str:
    return _SHIFTED.replace("{source}", source).replace("{where}", where)


_STATEMENTS = {
    "load_snapshot_csv": _ALL_ITEMS,
    "path_partition_columns": f"SELECT {_KEY}, count(*) AS LineCount FROM items GROUP BY {_KEY}",
    "reload_one_snapshot": _ALL_ITEMS,
    "load_recent_captures": _ALL_ITEMS,
    "warehouse_roundtrip_orc": _ALL_ITEMS,
    "clean_index_report": f"""
        SELECT {_KEY}, row_number() OVER (PARTITION BY {_KEY} ORDER BY c, i, step) - 1 AS line_no, line
        FROM report
    """,
    "parse_index_report": _ITEMS.replace("{source}", "named"),
    "report_parse_errors": f"""
        SELECT {_KEY}, line_no, line,
            CASE WHEN prior_step = 1 THEN 'index' WHEN step = 3 AND digit = 9 THEN 'opcount'
                ELSE 'index or collection' END AS expected
        FROM damaged_numbered WHERE step = 3 AND digit IN (4, 9)
    """,
    "load_errors": f"""
        SELECT {_KEY}, line_no, line,
            CASE WHEN prior_step = 1 THEN 'index' WHEN step = 3 AND digit = 9 THEN 'opcount'
                ELSE 'index or collection' END AS expected
        FROM damaged_numbered WHERE step = 3 AND digit IN (4, 9)
    """,
    "load_issues": """
        SELECT mongo_hostname, days_post_epoch,
            CASE WHEN days_post_epoch % 7 = 0 THEN seconds_of_day % 10000 + 90000 ELSE seconds_of_day END
                AS seconds_of_day,
            count(*) FILTER (UseCount % 10 IN (4, 9))::BIGINT AS CorruptCount,
            count(*) FILTER (days_post_epoch % 7 = 0)::BIGINT AS OutOfRangeSecondCount,
            count(*) FILTER (UseCount % 10 IN (4, 9))::BIGINT AS NullUseCountCount,
            count(*) FILTER (UseCount % 10 = 4)::BIGINT AS NullSinceCount
        FROM items GROUP BY ALL HAVING OutOfRangeSecondCount > 0 OR CorruptCount > 0
    """,
    "overwrite_dynamic": _shifted("facts", "days_post_epoch >= 19740"),
    "overwrite_dynamic_host": _shifted("policy", "mongo_hostname = 'mongo02'"),
    "op_count_item": _ALL_ITEMS,
    "collection_ops_agg": "SELECT * FROM facts",
    "index_ops_agg": _INDEX_FACTS,
    "index_ops_agg_recompute": _INDEX_FACTS,
    "known_collections": "SELECT * FROM known",
    "distinct_snapshots": "SELECT * FROM snaps",
    "partition_ranges": "SELECT * FROM ranges",
    "partition_labels": """
        SELECT mongo_hostname, partition_rank, ascending_label, descending_label FROM ranges
    """,
    "collection_grid": f"SELECT {_KEY}, PartitionRank, CollectionName, KnownAsOfEpoch FROM grid",
    "before_after_grid": "SELECT * FROM before_after",
    "discrete_labels": "SELECT * FROM discrete",
    "discrete_labels_v1": "SELECT * FROM discrete_v1",
    "activity_policy_labels": "SELECT * FROM policy",
    "activity_policy_labels_n7": "SELECT * FROM policy_n7",
    "activity_policy_labels_n4": "SELECT * FROM policy_n4",
    "activity_policy_labels_v1": "SELECT * FROM policy_v1",
    "sankey_edges": "SELECT mongo_hostname, StateBefore, StateAfter, EdgeCount FROM edges",
    "sankey_rows": f"SELECT mongo_hostname, {_ROW} AS sankey_row FROM edges",
    "sankey_report": """
        SELECT mongo_hostname,
            regexp_replace(
                replace(replace(replace(replace(replace(line, 'NotLoaded', 'NL'),
                    'NotCreated', 'NC'), 'Active', 'A'), 'Idle', 'I'), 'Restorable', 'R'),
                '(Deleted|Inactive).*', '\\1') AS sankey_row
        FROM (SELECT mongo_hostname, {row} AS line FROM edges)
        WHERE NOT contains(line, '] Not') AND NOT starts_with(line, 'Delete')
            AND NOT starts_with(line, 'Inacti')
    """.replace("{row}", _ROW),
    "sankey_report_ordered": f"""
        SELECT g.pos AS ReportGroup, mongo_hostname, {_ROW} AS sankey_row
        FROM edges JOIN (VALUES
            (1, 'NotLoaded', ''), (1, 'NotCreated', ''), (2, 'Active', 'Deleted'),
            (3, 'Active', 'Active'), (4, 'Restorable', 'Active'), (5, 'Restorable', 'Restorable'),
            (6, 'Active', 'Idle'), (7, 'Idle', 'Restorable'), (8, 'Idle', 'Active'),
            (9, 'Idle', 'Idle'), (10, 'Idle', 'Inactive')) AS g(pos, src, dst)
            ON b = g.src AND (g.dst = '' OR a = g.dst)
    """,
    "known_collections_legacy": "SELECT * FROM known_legacy",
    "initial_future_date": "SELECT * FROM horizon",
    "legacy_activity_labels": "SELECT * FROM legacy_labels",
    "change_navigation": """
        SELECT mongo_hostname, CollectionName, PartitionRank, CollectionUseStatus,
            CollectionUseStatusBefore, ChangedAtRank, ChangedUseStatusTo, PriorChangeRank,
            PriorChangeStatus, PriorChangeRankTwo, PriorChangeStatusTwo
        FROM nav
    """,
    "basic_sankey": """
        SELECT l.mongo_hostname, l.AscendingLabel, l.CurrentPartitionRank, l.ThisEventAt,
            r.ascending_label AS PriorAscendingLabel, l.CollectionUseStatusBefore,
            l.CollectionUseStatus, l.PriorEventAt, count(*) AS EdgeCount
        FROM legacy_labels l JOIN ranges r
            ON r.mongo_hostname = l.mongo_hostname AND r.this_event_at = l.PriorEventAt
        GROUP BY ALL
    """,
    "dup_items": _duplicates("items", "CollectionName, IndexName"),
    "dup_collection_agg": _duplicates("facts", "CollectionName"),
    "dup_index_agg": _duplicates("index_facts", "IndexName"),
    "snapshot_counts_items": _counts("items"),
    "snapshot_counts_collections": _counts("facts"),
    "snapshot_counts_indexes": _counts("index_facts"),
    "instant_counts_items": _counts("items", _INSTANT),
    "instant_counts_collections": _counts("facts", _INSTANT),
    "label_counts": f"""
        SELECT {_INSTANT}, CollectionUseStatus, count(*) AS LabelCount
        FROM discrete WHERE days_post_epoch IN (19730, 19745) GROUP BY ALL
    """,
    "label_counts_detailed": f"""
        SELECT {_INSTANT}, CollectionUseStatus, ActivityPolicyStatus, count(*) AS LabelCount
        FROM policy WHERE days_post_epoch IN (19730, 19745) GROUP BY ALL
    """,
    "label_lookup": """
        SELECT * FROM discrete WHERE CollectionName = 'c2_click' AND days_post_epoch = 19745
    """,
    "startup_dates": """
        SELECT i.mongo_hostname, i.CollectionName, min(i.Since) AS MinSince,
            min(s.PostSince) AS PostSince
        FROM first_items i JOIN starts s ON s.mongo_hostname = i.mongo_hostname
        WHERE i.Since <= s.PostSince GROUP BY i.mongo_hostname, i.CollectionName
    """,
    "cohort_overlap": """
        SELECT count(*) AS CollectionCount FROM (
            SELECT mongo_hostname, CollectionName FROM facts WHERE days_post_epoch = 19725
            INTERSECT
            SELECT mongo_hostname, CollectionName FROM facts WHERE days_post_epoch = 19750)
    """,
}


# Statements on the items that are left once some captures have become empty.
_EMPTIED = "NOT (days_post_epoch = 19740 AND mongo_hostname IN ('mongo02', 'mongo03'))"
_AFTER_EMPTYING = {
    "reload_emptied_snapshot": _ALL_ITEMS,
    "facts_of_changed_captures": "SELECT * FROM facts",
    "labels_of_changed_hosts": "SELECT * FROM policy",
}


def statements() -> dict[str, str]:
    found = {name: statement(body) for name, body in _STATEMENTS.items()}
    return found | {name: statement(body, _EMPTIED) for name, body in _AFTER_EMPTYING.items()}
