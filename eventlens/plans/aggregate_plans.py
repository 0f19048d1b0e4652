"""Registered queries: heatmaps and serving aggregates."""
from __future__ import annotations

from eventlens import lexicons as L
from eventlens.operators import aggregates as A
from eventlens.plans.base import EVENT_AS_OF, plan


def _coords_values() -> str:
    return ", ".join(f"('{c}', CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))"
                     for c, lat, lon in L.COUNTRY_COORDS)


COORDS_CTE = {"f_coords": f"SELECT * FROM (VALUES {_coords_values()}) AS t(country, latitude, longitude)"}


@plan("agg01_event_heatmap", oracle=f"""
    SELECT h.country, h.event_count, h.avg_severity, h.avg_confidence, h.conflict_share,
           c.latitude, c.longitude
    FROM (SELECT trim(country) AS country, count(*) AS event_count,
                 coalesce(avg(CAST(severity AS DOUBLE)), 0.0) AS avg_severity,
                 coalesce(avg(confidence_score), 0.0) AS avg_confidence,
                 avg(CASE WHEN event_type = 'conflict' THEN 1.0 ELSE 0.0 END) AS conflict_share
          FROM f_event
          WHERE status IN ('auto_approved', 'human_approved') AND published_at IS NOT NULL
            AND published_at >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 90 DAY
            AND country IS NOT NULL AND trim(country) <> ''
          GROUP BY 1) h
    LEFT JOIN f_coords c ON h.country = c.country
    ORDER BY h.event_count DESC, h.country LIMIT 80""", extra_ctes=COORDS_CTE)
def agg01(t):
    """AGG-01 + TXT-12: country heatmap over the last 90 days."""
    return A.event_heatmap(t.event, EVENT_AS_OF, days=90, n=80)
