from .counted import stream_count_windows
from .run import (QueryTotals, closing_packet, latest_counters, query_totals, run_counters, run_stream, write_stream)
from .rule_state import RuleState, run_with_rule_log
from .detectors import stream_classic_detector, stream_sliding_detector
from .stateful import stream_cma
from .windows import running_counters, stream_escalation, stream_rounds, stream_sliding_counts
