"""Reading tables and bringing them to the canonical long form ``series_id, ts, y, exog...``."""
