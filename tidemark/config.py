"""Settings and the sensor catalog, as plain dataclasses."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class MetricField:
    unit: str
    min: float
    max: float
    baseline: float
    noise_std: float


@dataclass(frozen=True)
class AnomalyPattern:
    type: str
    field: str
    multiplier: float | None = None
    slope: float | None = None


@dataclass(frozen=True)
class SensorType:
    description: str
    fields: dict[str, MetricField]
    anomaly_patterns: tuple[AnomalyPattern, ...] = ()


@dataclass(frozen=True)
class Rule:
    warn_above: float | None = None
    critical_above: float | None = None
    warn_below: float | None = None
    critical_below: float | None = None


@dataclass(frozen=True)
class Catalog:
    """Which metric fields each sensor type may report, and the alarm rules.

    Hand-written configuration, so it is bounded by what people maintain; it
    enters plans as literal expressions rather than as a joined table.
    """

    sensor_types: dict[str, SensorType]
    rules: dict[str, Rule]

    @staticmethod
    def from_dict(raw: dict) -> Catalog:
        types = {
            name: SensorType(
                description=spec.get("description", ""),
                fields={
                    f: MetricField(
                        d["unit"], float(d["min"]), float(d["max"]), float(d["baseline"]), float(d["noise_std"])
                    )
                    for f, d in spec["fields"].items()
                },
                anomaly_patterns=tuple(AnomalyPattern(**p) for p in spec.get("anomaly_patterns", ())),
            )
            for name, spec in raw["sensor_types"].items()
        }
        rules = {f: Rule(**{k: float(v) for k, v in r.items()}) for f, r in raw.get("rules", {}).items()}
        return Catalog(types, rules)

    @staticmethod
    def load(path: str) -> Catalog:
        return Catalog.from_dict(_read_mapping(path))


# Default sensor catalog and alarm rules.
DEFAULT_CATALOG = Catalog(
    sensor_types={
        "industrial": SensorType(
            "Factory machine telemetry",
            {
                "temperature": MetricField("celsius", -20.0, 120.0, 65.0, 2.0),
                "pressure": MetricField("bar", 0.0, 10.0, 4.5, 0.15),
                "vibration": MetricField("mm/s", 0.0, 50.0, 3.2, 0.4),
            },
            (
                AnomalyPattern("spike", "temperature", multiplier=2.5),
                AnomalyPattern("drift", "vibration", slope=0.05),
                AnomalyPattern("flatline", "pressure"),
            ),
        ),
        "vehicle": SensorType(
            "Fleet vehicle telemetry",
            {
                "speed": MetricField("km/h", 0.0, 200.0, 60.0, 5.0),
                "engine_rpm": MetricField("rpm", 0.0, 8000.0, 2200.0, 150.0),
                "fuel_level": MetricField("percent", 0.0, 100.0, 72.0, 0.5),
            },
            (AnomalyPattern("spike", "engine_rpm", multiplier=1.8),),
        ),
        "network": SensorType(
            "Network flow telemetry",
            {
                "bytes_in": MetricField("bytes", 0.0, 1000000000.0, 50000.0, 8000.0),
                "bytes_out": MetricField("bytes", 0.0, 1000000000.0, 30000.0, 5000.0),
                "packet_loss": MetricField("percent", 0.0, 100.0, 0.1, 0.05),
            },
            (AnomalyPattern("spike", "bytes_in", multiplier=10.0),),
        ),
    },
    rules={
        "temperature": Rule(warn_above=95.0, critical_above=110.0),
        "pressure": Rule(warn_below=1.0, critical_below=0.5),
        "vibration": Rule(warn_above=15.0, critical_above=25.0),
        "packet_loss": Rule(warn_above=1.0, critical_above=5.0),
    },
)

# The four scoring methods, in tie-breaking order.
METHODS = ("statistical", "isolation_forest", "autoencoder", "rule_based")


@dataclass(frozen=True)
class Tenancy:
    enabled: bool = False
    default_tenant: str = "default"
    tenants: tuple[str, ...] = ()


@dataclass(frozen=True)
class KafkaTopics:
    bootstrap_servers: str = "localhost:9092"
    topic: str = "telemetry.events"
    topic_template: str = "telemetry.events.{tenant_id}"
    topic_per_tenant: bool = False
    tenant_topics: dict[str, str] = field(default_factory=dict)
    auto_offset_reset: str = "latest"
    replay_mode: bool = False
    max_offsets_per_trigger: int | None = None


# Defaults of every tunable below.
@dataclass(frozen=True)
class Ewma:
    z_score_threshold: float = 3.5
    alpha: float = 0.1
    min_samples: int = 20
    history: int = 512


@dataclass(frozen=True)
class HalfSpace:
    n_trees: int = 10
    height: int = 8
    window: int = 250
    seed: int = 42
    limits: str = "catalog"  # "catalog": scale by the catalog's min/max; "unit": values used as they are

    def __post_init__(self):
        assert self.limits in ("catalog", "unit")


@dataclass(frozen=True)
class Autoencoder:
    enabled: bool = True
    hidden_dim: int = 8
    learning_rate: float = 0.01
    min_samples: int = 30
    error_threshold: float = 0.15
    seed: int = 42


@dataclass(frozen=True)
class Drift:
    enabled: bool = True
    adwin_delta: float = 0.002
    check_interval_seconds: float = 30.0


@dataclass(frozen=True)
class Detection:
    enabled: bool = True
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "statistical": 0.25,
            "isolation_forest": 0.30,
            "rule_based": 0.15,
            "autoencoder": 0.30,
        }
    )
    ewma: Ewma = Ewma()
    trees: HalfSpace = HalfSpace()
    autoencoder: Autoencoder = Autoencoder()
    drift: Drift = Drift()
    alert_threshold: float = 0.65


@dataclass(frozen=True)
class Alerting:
    min_severity: str = "medium"
    cooldown_seconds: float = 60.0

    def __post_init__(self):
        assert self.min_severity in ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class Evaluation:
    warmup_events: int = 50
    threshold: float | None = None
    threshold_sweep: tuple[float, ...] = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)


@dataclass(frozen=True)
class Settings:
    environment: str = "local"
    window_size_seconds: float = 10.0
    slide_interval_seconds: float = 2.0
    dedup_window_seconds: float = 5.0
    drop_invalid: bool = True
    retention_days: int = 90
    compression_after_days: int = 7
    latency_buckets_ms: tuple[float, ...] = (1, 5, 10, 25, 50, 100, 250, 500, 1000)
    tenancy: Tenancy = Tenancy()
    kafka: KafkaTopics = KafkaTopics()
    detection: Detection = Detection()
    alerting: Alerting = Alerting()
    evaluation: Evaluation = Evaluation()

    def __post_init__(self):
        assert self.window_size_seconds > 0 and self.slide_interval_seconds > 0
        assert self.dedup_window_seconds >= 0

    @staticmethod
    def from_dict(raw: dict) -> Settings:
        return _build(Settings, raw)

    @staticmethod
    def load(path: str) -> Settings:
        return Settings.from_dict(_read_mapping(path))


def _build(cls, raw):
    """Nested dict -> nested dataclass; keys that are not settings are an error."""
    hints = {f.name: getattr(cls(), f.name) for f in dataclasses.fields(cls)}
    values = {}
    for name, value in raw.items():
        default = hints[name]
        if dataclasses.is_dataclass(default):
            value = _build(type(default), value)
        elif isinstance(default, tuple):
            value = tuple(value)
        values[name] = value
    return cls(**values)


def _read_mapping(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML settings needs the yaml package; JSON works without it") from missing
    return yaml.safe_load(text)
