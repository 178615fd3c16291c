"""Settings as frozen dataclasses, checked when they are made; an error names the key."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from datetime import date


class ConfigError(ValueError):
    """A setting that is missing or does not make sense."""


@dataclass(frozen=True)
class Carrier:
    carrier_id: str
    carrier_name: str
    mode: str
    layout: str
    variants: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tolerances:
    duplicate_amount: float = 1.00
    duplicate_window_days: int = 120
    rate_pct: float = 0.01
    rate_abs: float = 2.00
    fsc_ltl_pp: float = 0.25
    fsc_min_dollars: float = 1.00
    fsc_tl_abs: float = 2.00
    fsc_tl_pct: float = 0.005
    weight_pct: float = 0.02
    totals: float = 0.01
    fallback_days: int = 1
    fallback_weight_pct: float = 0.02


@dataclass(frozen=True)
class Fuel:
    ltl_base: str = "1.20"
    ltl_step: str = "0.10"
    ltl_pct_per_step: str = "0.009"
    tl_peg: str = "1.25"
    tl_mpg: str = "6.0"


@dataclass(frozen=True)
class Economics:
    review_minutes_per_flag: float = 6
    analyst_cost_per_hour: float = 45
    false_dispute_cost: float = 25
    min_precision: float = 0.90
    min_material_gain: float = 1000


@dataclass(frozen=True)
class Systemic:
    window_months: int = 3
    multiple: float = 3.0
    min_invoices: int = 20
    min_flags: int = 10
    alpha: float = 0.01


@dataclass(frozen=True)
class Accruals:
    trailing_days: int = 90
    default_ltl: float = 12.0
    default_tl: float = 8.0
    expense: str = "6100 Freight Expense"
    liability: str = "2150 Accrued Freight"
    large_error: float = 0.10
    driver_share: float = 0.5


#: fixed values: the carriers, layouts and spellings of the default network
CARRIERS = (
    Carrier("CARA", "Carrier A Freight", "LTL", "A", ("CARRIER A FREIGHT", "Carrier A Freight LLC", "Carr A Frt")),
    Carrier("CARB", "Carrier B Lines", "LTL", "B", ("CARRIER B LINES", "Carrier B Lines Inc")),
    Carrier("CARC", "Carrier C Express", "LTL", "C", ("CARRIER C EXPRESS", "Carrier C Exp.", "C Express")),
    Carrier("CARD", "Carrier D Transport", "LTL", "D", ("CARRIER D TRANSPORT", "Carrier D Trans")),
    Carrier("CARE", "Carrier E Freightways", "LTL", "A", ("CARRIER E FREIGHTWAYS", "Carrier E Fwy")),
    Carrier("CARF", "Carrier F Trucking", "TL", "B", ("CARRIER F TRUCKING", "Carrier F Trkg")),
    Carrier("CARG", "Carrier G Logistics", "TL", "C", ("CARRIER G LOGISTICS", "Carrier G Log.")),
    Carrier("CARH", "Carrier H Carriers", "TL", "D", ("CARRIER H CARRIERS", "Carrier H")),
)
#: fixed values: charge descriptions and the codes they stand for
CHARGES = {"FUEL SURCHARGE": "FSC", "LIFTGATE SERVICE": "LIFTGATE", "RESIDENTIAL DELIVERY": "RESIDENTIAL", "DETENTION - DRIVER": "DETENTION", "LINEHAUL": "LH"}
#: fixed values: the grids of the tolerance sweep
SWEEPS = {
    "rate_pct": (0.0, 0.0025, 0.005, 0.01, 0.02, 0.03, 0.05),
    "fsc_ltl_pp": (0.0, 0.1, 0.25, 0.5, 1.0, 2.0),
    "fsc_tl_pct": (0.0, 0.0025, 0.005, 0.01, 0.02, 0.05),
    "weight_pct": (0.0, 0.005, 0.01, 0.02, 0.03, 0.05),
}


@dataclass(frozen=True)
class Network:
    """What a shipper's network must satisfy: lanes between its origins and destinations, shares of the year's shipments by month (empty: even), carriers of a mode on a lane."""

    lanes: int = 60
    origins: int = 8
    destinations: int = 16
    monthly_weights: tuple[float, ...] = ()
    carriers_per_lane: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Config:
    start: date = date(2025, 1, 1)
    months: int = 12
    audit_as_of: date = date(2026, 3, 31)
    seed: int = 42
    shipments: int = 10_000
    top_n: int = 10
    carriers: tuple[Carrier, ...] = CARRIERS
    charges: Mapping[str, str] = field(default_factory=lambda: dict(CHARGES))
    sweeps: Mapping[str, tuple[float, ...]] = field(default_factory=lambda: dict(SWEEPS))
    tolerances: Tolerances = Tolerances()
    fuel: Fuel = Fuel()
    economics: Economics = Economics()
    systemic: Systemic = Systemic()
    accruals: Accruals = Accruals()
    network: Network = Network()

    def __post_init__(self) -> None:
        positive = {"months": self.months, "shipments": self.shipments, "top_n": self.top_n, "systemic.window_months": self.systemic.window_months, "accruals.trailing_days": self.accruals.trailing_days, "fuel.ltl_step": float(self.fuel.ltl_step), "fuel.tl_mpg": float(self.fuel.tl_mpg)}
        for key, value in positive.items():
            if not value > 0:
                raise ConfigError(f"{key} must be positive, not {value}")
        for f in fields(Tolerances):
            if getattr(self.tolerances, f.name) < 0:
                raise ConfigError(f"tolerances.{f.name} must not be negative")
        for share in ("min_precision",):
            if not 0 <= getattr(self.economics, share) <= 1:
                raise ConfigError(f"economics.{share} must lie between 0 and 1")
        ids = [c.carrier_id for c in self.carriers]
        if len(set(ids)) != len(ids):
            raise ConfigError("carriers: an id repeats")
        for c in self.carriers:
            if c.mode not in ("LTL", "TL"):
                raise ConfigError(f"carriers.{c.carrier_id}.mode must be LTL or TL, not {c.mode}")
            if c.layout not in ("A", "B", "C", "D"):
                raise ConfigError(f"carriers.{c.carrier_id}.layout must be one of A, B, C, D, not {c.layout}")
        net = self.network
        if net.lanes > net.origins * net.destinations:
            raise ConfigError(f"network.lanes: {net.lanes} exceed the {net.origins * net.destinations} pairs of origins and destinations")
        if net.monthly_weights and len(net.monthly_weights) != self.months:
            raise ConfigError(f"network.monthly_weights has {len(net.monthly_weights)} entries for {self.months} months")
        if net.monthly_weights and abs(sum(net.monthly_weights) - 1) > 1e-9:
            raise ConfigError(f"network.monthly_weights must sum to 1, not {sum(net.monthly_weights)}")
        for mode, needed in net.carriers_per_lane:
            there = sum(c.mode == mode for c in self.carriers)
            if needed > there:
                raise ConfigError(f"network.carriers_per_lane.{mode}: {needed} of {there} carriers")
        for name in self.sweeps:
            if not hasattr(self.tolerances, name):
                raise ConfigError(f"sweeps.{name} is no tolerance")

    def get(self, path: str):
        """A setting by its dotted key."""
        value = self
        for part in path.split("."):
            try:
                value = value[part] if isinstance(value, Mapping) else getattr(value, part)
            except (KeyError, AttributeError):
                raise ConfigError(f"no setting {path}") from None
        return value


def from_mapping(values: Mapping, base: Config | None = None) -> Config:
    """A config with some settings replaced, from nested mappings such as a parsed YAML or JSON file."""
    base = base or Config()

    def put(part, given, path):
        names = {f.name: f for f in fields(part)}
        changes = {}
        for key, value in given.items():
            if key not in names:
                raise ConfigError(f"unknown setting {path}{key}")
            old = getattr(part, key)
            if is_dataclass(old):
                value = put(old, value, f"{path}{key}.")
            elif key == "carriers":
                value = tuple(c if isinstance(c, Carrier) else Carrier(**{**c, "variants": tuple(c.get("variants", ()))}) for c in value)
            elif isinstance(old, date) and isinstance(value, str):
                value = date.fromisoformat(value)
            changes[key] = value
        return replace(part, **changes)

    return put(base, values, "")


def load(path: str) -> Config:
    """From a JSON file, or a YAML file where PyYAML is installed."""
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        import json

        return from_mapping(json.loads(text))
    try:
        import yaml
    except ImportError:
        raise ConfigError("YAML settings need PyYAML; use JSON") from None
    return from_mapping(yaml.safe_load(text))
