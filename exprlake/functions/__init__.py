from exprlake.functions.columns import (  # noqa: F401
    clean_name,
    correlation,
    draw_key,
    draw_unit,
    finite,
    fixed,
    nan_to_null,
    safe_div,
    sort_prefix,
    strip_copy_suffix,
)
from exprlake.functions.vectors import (  # noqa: F401
    all_finite,
    centred_unit,
    dot,
    norm,
    unit,
    vector_mean,
    vector_width,
)
