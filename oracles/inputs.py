"""Common table expressions the checking SQL starts with."""

from datetime import datetime

from millwright.sources.event_readings import RAW, SECOND_COPY, TYPED

_COLUMNS = ",\n    ".join(f"{text} AS {name}" for name, text in TYPED.items())
_RAW_COLUMNS = ",\n    ".join(f"{text} AS {name}" for name, text in RAW.items())

READINGS = f"""readings AS (
  SELECT
    {_COLUMNS}
  FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE {SECOND_COPY})
)"""

RAW_READINGS = f"""{READINGS}, raw_readings AS (
  SELECT
    {_RAW_COLUMNS}
  FROM readings
)"""


def on_readings(sql: str) -> str:
    return f"WITH {READINGS}\n{sql.strip()}"



def on_readings_of(sql: str, start: datetime, end: datetime) -> str:
    """The same of the readings from `start` to before `end`."""
    period = f"timestamp >= TIMESTAMP '{start}' AND timestamp < TIMESTAMP '{end}'"
    return f"WITH all_{READINGS}, readings AS (SELECT * FROM all_readings WHERE {period})\n{sql.strip()}"
