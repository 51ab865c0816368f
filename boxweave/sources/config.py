"""Configuration: YAML files to plain objects, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from ..operators.labels import LabelSpace


def resolve(path: str, anchor: str | Path = ".") -> str:
    """A path against a folder; absolute paths, URLs and ~ stand for themselves."""
    if "://" in path:
        return path
    p = Path(path).expanduser()
    return str(p if p.is_absolute() else Path(anchor) / p)


def parse_yaml(text: str) -> dict[str, Any]:
    import yaml

    return yaml.safe_load(text) or {}


def read_yaml(path: str | Path) -> dict[str, Any]:
    return parse_yaml(Path(path).expanduser().read_text())


def _ending(config: dict[str, Any], end: str, default: Any) -> Any:
    """The value of the first key that ends so; configurations prefix theirs."""
    return next((v for k, v in config.items() if str(k).endswith(end)), default)


def label_space(config: dict[str, Any]) -> LabelSpace:
    """A label space from a configuration with a list ``...classes``, class_groups,
    class_descriptions and a ``...policy``."""
    return LabelSpace(
        [str(c) for c in _ending(config, "classes", None) or []],
        {str(k): [str(m) for m in v] for k, v in (config.get("class_groups") or {}).items()},
        {str(k): str(v) for k, v in (config.get("class_descriptions") or {}).items()},
        _ending(config, "policy", "background"),
    )


@dataclass(frozen=True)
class PrepareConfig:
    """Parameters of a preparation run, with their defaults."""

    mode: str = "stratified_tile"
    seed: int = 42
    valid_fraction: float = 0.10
    group_by_page: bool = True
    fractions: dict[str, float] = field(default_factory=lambda: {"train": 0.78, "valid": 0.10, "test": 0.12})
    min_test_atoms: int = 5
    min_valid_atoms: int = 3
    min_pages: int = 1
    max_pages: int | None = None
    tile_size: int = 1280
    overlap: float = 0.0
    fit: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("stratified_tile", "page_grouped"):
            raise ValueError(f"unknown split mode {self.mode!r}")

    @classmethod
    def of(cls, given: dict[str, Any]) -> PrepareConfig:
        """From flat keys, or from a run's configuration with the sections split and
        slicing; a key of these that isn't known is an error.  Other sections (paths,
        training, inference) are for other programs."""
        if not isinstance(given.get("split"), dict):
            return cls(**_known(given, {f.name: f.name for f in fields(cls)}, "the configuration"))
        split, slicing = dict(given["split"]), dict(given.get("slicing") or {})
        tiles, drawing = split.pop("stratified_tile", None) or {}, split.pop("drawing_test", None) or {}
        found = _known(split, {"mode": "mode", "seed": "seed", "valid_fraction": "valid_fraction", "group_by_page_prefix": "group_by_page"}, "split")
        parts = _known(tiles, {
            "train_fraction": "train", "valid_fraction": "valid", "test_fraction": "test",
            "min_test_atoms_per_class": "min_test_atoms", "min_valid_atoms_per_class": "min_valid_atoms",
        }, "split.stratified_tile")
        shares = {k: float(parts.pop(k)) for k in ("train", "valid", "test") if k in parts}
        held = _known(drawing, {"enabled": "enabled", "min_clusters_per_class": "min_pages", "max_clusters": "max_pages"}, "split.drawing_test")
        if held.get("max_pages") in ("", "null"):
            held["max_pages"] = None
        if not held.pop("enabled", True):
            held["max_pages"] = 0
        cut = _known(slicing, {"slice_size": "tile_size", "overlap": "overlap", "fit_box_to_slice": "fit"}, "slicing")
        own = {**found, **parts, **held, **cut}
        if shares:
            own["fractions"] = {**cls().fractions, **shares}
        return cls(**own)


def _known(given: dict[str, Any], names: dict[str, str], where: str) -> dict[str, Any]:
    if strange := sorted(set(map(str, given)) - set(names)):
        raise ValueError(f"{where} has unknown keys: {', '.join(strange)}")
    return {names[k]: v for k, v in given.items()}


@dataclass(frozen=True)
class InferenceConfig:
    tile_size: int = 1280
    overlap: float = 0.25
    min_confidence: float = 0.25
    batch_size: int = 16
    iou: float = 0.5

    @classmethod
    def of(cls, given: dict[str, Any]) -> InferenceConfig:
        """From a run's section inference; the size that the model scales tiles to is
        the scorer's own matter."""
        own = dict(given.get("inference", given))
        own.pop("model_input_size", None)
        return cls(**_known(own, {
            "slice_size": "tile_size", "overlap": "overlap", "conf_threshold": "min_confidence", "batch_size": "batch_size", "nms_iou_threshold": "iou",
        }, "inference"))
