from martlet.functions.scalar import (
    exact_avg_round,
    half_even_round,
    lenient_date,
    money_text,
    norm_enum,
    norm_text,
    ratio_or_zero,
    safe_ratio,
    to_number,
)

__all__ = [
    "exact_avg_round", "half_even_round", "lenient_date", "money_text", "norm_enum",
    "norm_text", "ratio_or_zero", "safe_ratio", "to_number",
]
