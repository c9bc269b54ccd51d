from logjury.streaming.pipeline import (
    RecentStore,
    TooManyMalformed,
    judge_stream,
    normalize_stream,
    run_recent,
    run_to_table,
)
from logjury.streaming.state import keep_recent, kept_recent

__all__ = ["RecentStore", "TooManyMalformed", "judge_stream", "keep_recent", "kept_recent", "normalize_stream", "run_recent", "run_to_table"]
