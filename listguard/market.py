"""Values that differ between marketplaces; supplied by the user, never built in."""

from __future__ import annotations

from dataclasses import dataclass, field

# Country codes and names.
COUNTRIES = {"KE": "Kenya", "UG": "Uganda", "NG": "Nigeria", "GH": "Ghana", "MA": "Morocco"}

# File-name prefixes used by the weekly exports.
WEEKLY_PREFIXES = {
    "KE": "Kenya", "UG": "Uganda", "NG": "Nigeria", "GH": "Ghana", "MA": "Morocco",
    "MO": "Morocco", "EG": "Egypt", "CI": "Ivory Coast", "SN": "Senegal", "ZA": "South Africa",
}

# Flags a country leaves out.
COUNTRY_SKIPS = {"UG": ("Counterfeit Sneakers", "Product Warranty", "Generic BRAND Issues")}

# Country values that mean "listed in several countries".
MULTI_COUNTRY = ("MULTIPLE", "MULTI")

# Currency code, symbol, fallback rate per US dollar, decimals.
CURRENCIES = {
    "Kenya": ("KES", "KSh", 128.0, 0),
    "Uganda": ("UGX", "USh", 3750.0, 0),
    "Nigeria": ("NGN", "₦", 1550.0, 0),
    "Ghana": ("GHS", "GH₵", 15.5, 2),
    "Morocco": ("MAD", "MAD", 10.1, 2),
}


@dataclass(frozen=True)
class Market:
    """One marketplace's naming: shop prefix, official-store tag, web domains."""

    name: str = "the marketplace"
    shop_prefix: str = "SHOP-"
    official_tag: str = "OFFICIAL"
    domains: dict = field(default_factory=dict)  # domain -> country code
    image_hosts: tuple = ()


DEFAULT_MARKET = Market()
