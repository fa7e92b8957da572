"""Thresholds of the analyses in one object that is passed to operators."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    # fixed values
    window_days: int = 365
    excluded_folders: tuple[str, ...] = (
        "node_modules", "dist", "build", "out", "coverage", ".next", ".turbo", ".cache", "storybook-static",
    )
    eligible_kinds: tuple[str, ...] = ("source", "test", "story", "config")
    config_dominant_share: float = 0.5
    source_dominant_config_share: float = 0.25
    max_code_files: int = 40
    config_sweep_packages: int = 5
    min_support: int = 3
    min_conditional: float = 0.5
    min_jaccard: float = 0.3
    max_bucket: int = 40
    hotspot_kinds: tuple[str, ...] = ("source",)
    hotspot_percentile: float = 0.9
    branch_heavy: int = 6
    deep_nesting: int = 4
    dense_decisions: int = 15
    dense_functions: int = 5
    central_fan_in: int = 20
    central_fan_out: int = 10
    min_fan: int = 3
    dominant_share: float = 0.6
    high_share: float = 0.8
    distributed_share: float = 0.5
    distributed_consumers: int = 3
    high_fan_in: int = 4
    high_fan_out: int = 6
    foundation_fan_in: int = 2
    foundation_fan_out: int = 1
    integration_fan_in: int = 2
    integration_fan_out: int = 3
    leaf_fan_in: int = 1
    leaf_fan_out: int = 2
    hub_fan_in: int = 3
    hub_consumers: int = 3
    hub_distribution: float = 1.5
    surface_symbols: int = 20
    surface_utilization: float = 0.25
    broad_consumers: int = 3
    pressure_symbols: int = 50
    pressure_import_sites: int = 50
    pressure_fan: int = 3
    pressure_reach: float = 0.1
    pressure_references: int = 100
    pressure_destination: float = 0.2
    pressure_depth: int = 10
    pressure_top_fan_in: int = 20
    pressure_functions: int = 3
    boundary_symbols: int = 25
    boundary_sites: int = 20
    boundary_share: float = 0.5
    min_history: int = 10
    structural_hub_percentile: float = 0.95
    structural_hub_fan_in: int = 20
    significant_share: float = 0.1
    locality_consumers: int = 2
    strong_multiple: int = 2
    reference_packages: int = 3
    reference_share: float = 0.5
    representation_share: float = 0.75
    representation_count: int = 3
    seam_pairs: int = 1
    seam_region: int = 2
    corridor_length: int = 2
    corridor_support: int = 2
    corridor_paths: int = 32
    narrow_distribution: float = 2.0


DEFAULT = Policy()
