"""Twins of the ingest and stream-metric queries."""
_CLOSED = "SELECT * FROM b_window WHERE window_end <= (SELECT max(emitted_at) - INTERVAL 30 SECOND FROM b_clean)"

SQL = {
    "parse_envelope": "SELECT kafka_ts, event_id, type, sim_time, emitted_at, order_id, city_id, route_id FROM b_parsed",
    "reject_reason": "SELECT coalesce(reason, 'valid') AS reason, type, count(*) AS rows FROM b_checked GROUP BY 1, 2",
    "quarantine": """SELECT reason, event_id, type, kafka_ts, CAST(least(1024, CASE WHEN fault = 6 THEN length('not json '||e) ELSE
        CASE WHEN event_id IS NOT NULL THEN length('"event_id":"",'||event_id) ELSE 0 END + length('"type":"",'||type)
        + CASE WHEN fault = 8 THEN length('"sim_time":"not a time",') ELSE length('"sim_time":"2024-01-01T00:00:00.000000Z",') END
        + CASE WHEN fault = 5 THEN length('"emitted_at":"2099-01-01T00:00:00Z",') ELSE length('"emitted_at":"2024-01-01T00:00:00.000000Z",') END
        + CASE WHEN order_id IS NOT NULL THEN length('"order_id":"",'||order_id) ELSE 0 END + CASE WHEN city_id IS NOT NULL THEN length('"city_id":"",'||city_id) ELSE 0 END
        + length('"route_id":"",'||route_id) + length('"payload":"{"delay_min":}"') + 4 + length(CAST(value AS VARCHAR)) END) AS INTEGER) AS raw_chars
        FROM b_checked WHERE reason IS NOT NULL""",
    "clean_dedup": "SELECT event_id, type, sim_time, emitted_at, order_id, city_id, route_id, kafka_ts FROM b_clean",
    "reject_counts": "SELECT reason, count(*) AS rows FROM b_checked WHERE reason IS NOT NULL GROUP BY 1",
    "agg_city_window": "SELECT * FROM b_window",
    "agg_network_window": """SELECT window_start, CAST(sum(events) AS BIGINT) AS events, CAST(sum(created) AS BIGINT) AS created, CAST(sum(dispatched) AS BIGINT) AS dispatched,
        CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(delays) AS BIGINT) AS delays FROM b_window GROUP BY 1 ORDER BY 1 DESC LIMIT 20 OFFSET 3""",
    "event_type_counts": "SELECT type, count(*) AS events FROM b_clean GROUP BY 1",
    "trailing_event_rate": """SELECT round(count(*)/60, 1) AS events_per_s FROM b_clean WHERE emitted_at BETWEEN (SELECT max(emitted_at) FROM b_clean) - INTERVAL 60 SECOND
        AND (SELECT max(emitted_at) FROM b_clean)""",
    "event_freshness": "SELECT event_id, type, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(emitted_at))/1e6, 1) AS freshness_s FROM b_clean ORDER BY emitted_at DESC, event_id DESC LIMIT 1",
    # streams: the batch result restricted to what the watermark has closed
    "src_event_stream": "SELECT CAST(ts AS DATE) AS day, count(*) AS messages FROM b_msg GROUP BY 1",
    "stream_dedup": "SELECT event_id, type, emitted_at, order_id, city_id FROM b_clean",
    "stream_tumbling": _CLOSED,
    "stream_watermark": f"SELECT max(window_end) AS last_closed, count(*) AS windows, CAST(sum(events) AS BIGINT) AS events FROM ({_CLOSED})",
    "stream_branches": f"""SELECT 'quarantine' AS branch, count(*) AS rows FROM b_checked WHERE reason IS NOT NULL UNION ALL SELECT 'clean', count(*) FROM b_clean
        UNION ALL SELECT 'metrics', count(*) FROM ({_CLOSED}) UNION ALL SELECT 'raw', count(*) FROM b_checked""",
    "stream_late_data": """SELECT CAST(count(*) FILTER (reason IS NULL AND emitted_at < (SELECT max(emitted_at) - INTERVAL 30 SECOND FROM b_clean)) AS BIGINT) AS dropped_late, count(*) AS rows FROM b_checked""",
    "stream_dup_counter": "SELECT CAST((SELECT count(*) FROM b_checked WHERE reason IS NULL) - (SELECT count(*) FROM b_clean) AS BIGINT) AS dropped_duplicates",
    "stream_triggers": "SELECT reason, count(*) AS rows FROM b_checked WHERE reason IS NOT NULL GROUP BY 1",
    "stream_progress_listener": "SELECT 'listened' AS name, CAST((SELECT count(*) FROM events) AS BIGINT) AS rows, CAST((SELECT count(*) FROM b_checked WHERE reason IS NULL) - (SELECT count(*) FROM b_clean) AS BIGINT) AS dropped_duplicates",
    "progress_digest": """SELECT 'digest' AS name, CAST((SELECT count(*) FROM events) AS BIGINT) AS rows,
        CAST((SELECT count(*) FROM b_checked WHERE reason IS NULL) - (SELECT count(*) FROM b_clean) AS BIGINT) AS dropped_duplicates, 0::BIGINT AS dropped_late""",
    "semi_known_ids": "SELECT city_id, count(*) AS events FROM b_clean WHERE city_id IN (SELECT city_id FROM b_city) GROUP BY 1",
}
