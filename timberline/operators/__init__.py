"""Operators: functions from log DataFrames to DataFrames."""

from timberline.operators.asof import asof_join
from timberline.operators.errorcodes import (
    code_table,
    decode_codes,
    error_lookup,
    error_lookup_in,
    load_codes,
    preferred_domain,
)
from timberline.operators.filters import (
    FilterPreset,
    LogFilter,
    apply_filter,
    find,
    preset_counts,
    toggle_level,
    visible_of_total,
)
from timberline.operators.histogram import (
    add_bucket,
    bucket_representatives,
    first_in_ranges,
    histogram,
    histogram_summary,
    peak_shadows,
    retain_peaks,
    spikes,
    time_span,
)
from timberline.operators.marks import (
    HighlightRule,
    bookmarked,
    bookmarks_by_source,
    highlight,
    toggle_bookmarks,
)
from timberline.operators.merge import (
    back_to_source,
    merge_label,
    merge_logs,
    merge_streams,
    source_list,
    tag_source,
)
from timberline.operators.navigation import (
    match_list,
    nearest_rows,
    neighbouring_errors,
    visible_position,
)
from timberline.operators.ordered import Run, number_rows, number_sorted, running
from timberline.operators.rates import line_rates, pause_buffer, pause_drops, pause_state, rate_seconds, shown_rate
from timberline.operators.summary import (
    column_flags,
    component_dictionary,
    encode_components,
    level_counts,
    level_counts_by,
    time_inversions,
)

__all__ = [name for name in dir() if not name.startswith("_")]
