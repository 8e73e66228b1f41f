"""crestline: enrichment peak calling and interval analytics on PySpark DataFrames."""

from crestline.config import CallOptions
from crestline.session import build_session, stage

__all__ = ["CallOptions", "build_session", "stage"]
