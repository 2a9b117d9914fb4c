"""Parameters: types, defaults and limits, checked before anything runs."""

from __future__ import annotations

import difflib
import json
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any


class ParameterError(ValueError):
    """A parameter that is unknown, missing, or out of its limits."""


@dataclass(frozen=True)
class Param:
    kind: type | str = float
    default: Any = None
    least: float | None = None
    most: float | None = None
    choices: tuple = ()
    required: bool = False

    def check(self, name: str, value: Any) -> Any:
        if value is None:
            if self.required:
                raise ParameterError(f"{name} is required")
            return self.default
        if self.kind == "time":
            return epoch(value)
        if self.kind == "points":
            try:
                return [tuple(float(v) for v in p) for p in value]
            except TypeError as e:
                raise ParameterError(f"{name} must be a list of points") from e
        if self.kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, self.kind):
            raise ParameterError(f"{name} must be {self.kind.__name__}, not {value!r}")
        if self.least is not None and value < self.least or self.most is not None and value > self.most:
            raise ParameterError(f"{name} = {value!r} is out of its limits")
        if self.choices and any(v not in self.choices for v in (value if isinstance(value, list) else [value])):
            raise ParameterError(f"{name} = {value!r} is none of {self.choices}")
        return value


def epoch(value) -> float:
    """Seconds since 1970 of a number, a datetime, or an ISO text (UTC unless it says otherwise)."""
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).timestamp()


def merged(given: dict[str, Any], known: dict[str, Param], owner: str) -> dict[str, Any]:
    """All known parameters, checked; unknown names are refused with the nearest known one."""
    for name in given:
        if name not in known:
            if name in OBSOLETE:
                raise ParameterError(f"{owner}: {name} is obsolete; {OBSOLETE[name]}")
            near = difflib.get_close_matches(name, known, 1)
            raise ParameterError(f"{owner} has no parameter {name}" + (f"; did you mean {near[0]}?" if near else ""))
    return {n: p.check(f"{owner}.{n}", given.get(n)) for n, p in known.items()}


def statuses(names: list[str]) -> tuple[int, ...]:
    """Codes of particle statuses by name."""
    out = []
    for n in names:
        if n not in STATUSES:
            near = difflib.get_close_matches(n, STATUSES, 1)
            raise ParameterError(f"no status {n}" + (f"; did you mean {near[0]}?" if near else ""))
        out.append(STATUSES[n])
    return tuple(out)


#: Statuses by name.
STATUSES = {"notReleased": -10, "dead": -5, "outside_domain": -2, "outside_open_boundary": -1, "stationary": 0, "stranded_by_tide": 3, "on_bottom": 6, "moving": 10}
#: Settings of a run and their defaults.
SETTINGS = {
    "time_step": Param(float, 3600.0, 0.001), "backtracking": Param(bool, False), "max_run_duration": Param(float, None, 1e-5), "max_particles": Param(int, 10**10, 1),
    "RK_order": Param(int, 4, choices=(1, 2, 4)), "minimum_total_water_depth": Param(float, 0.25, 0.0), "z0": Param(float, 0.0003, 0.0001), "water_density": Param(float, 1025.0, 900.0),
    "use_open_boundary": Param(bool, False), "block_dry_cells": Param(bool, True), "use_dispersion": Param(bool, True), "use_resuspension": Param(bool, True), "use_A_Z_profile": Param(bool, False), "use_bottom_stress": Param(bool, True),
    "A_H": Param(float, 0.1, 0.0), "A_V": Param(float, 0.01, 0.0), "seed": Param(int, 0), "use_random_seed": Param(bool, False), "time_buffer_size": Param(int, 24, 2), "steps_per_block": Param(int, 24, 1), "use_geographic_coords": Param(bool, False),
    "write_tracks": Param(bool, True), "write_dry_cell_flag": Param(bool, True), "restart_interval": Param(float, None, 0.0), "continuable": Param(bool, False), "continue_from": Param(str), "run_output_dir": Param(str), "user_note": Param(str, "No user note"),
    "debug": Param(bool, False), "max_warnings": Param(int, 50, 0), "processors": Param(int, None, 1), "add_path": Param(list),
}
#: Names that are no longer used, and what to do.
OBSOLETE = {
    "root_output_dir": "use run_output_dir", "output_file_base": "use run_output_dir", "multiprocessing_case_start_delay": "there are no cases to delay", "regrid_z_to_uniform_sigma_levels": "regrid in the reader", "regrid_z_to_sigma_levels": "regrid in the reader",
}
RELEASE = {
    "name": Param(str, "group"), "pulse_size": Param(int, 1, 1), "release_interval": Param(float, 0.0, 0.0), "start": Param("time"), "end": Param("time"), "duration": Param(float, None, 0.0),
    "max_age": Param(float, None, 1.0), "points": Param("points", required=True), "user_release_groupID": Param(int, 0), "z_min": Param(float), "z_max": Param(float), "release_offset_from_surface_or_bottom": Param(float, 0.0, 0.0),
    "release_at_surface": Param(bool, False), "release_at_bottom": Param(bool, False), "water_depth_min": Param(float), "water_depth_max": Param(float), "allow_release_in_dry_cells": Param(bool, False),
}
ROLES = {
    "point": RELEASE,
    "radius": RELEASE | {"radius": Param(float, None, 0.0, required=True)},
    "downstream": RELEASE | {"distance": Param(float, None, 0.0, required=True)},
    "polygon": RELEASE,
    "grid": {k: v for k, v in RELEASE.items() if k != "points"} | {"rows": Param(int, None, 1, required=True), "cols": Param(int, None, 1, required=True), "span_x": Param(float, required=True), "span_y": Param(float, required=True), "center": Param(list, required=True)},
}
_CHANCE, _EVERY, _KINDS = Param(float, 1.0, 0.0, 1.0), Param(float, 3600.0, 0.0), Param(list, ["moving"])
#: Parts of a run that the kernel knows, by role and kind.
PARTS = {
    "velocity_modifiers": {"terminal_velocity": {"value": Param(float, 0.0)}, "rheotaxis": {"swim_speed": Param(float, 0.0, 0.0), "concentration": Param(float, 1.0, 1e-6)}},
    "dispersion": {"random_walk": {"A_H": Param(float, 0.1, 0.0), "A_V": Param(float, 0.01, 0.0)}},
    "resuspension": {"resuspension": {"critical_friction_velocity": Param(float, 0.0, 0.0)}, "basic_resuspension": {"critical_friction_velocity": Param(float, 0.0, 0.0)}},
    "tidal_stranding": {"tidal_stranding": {}},
    "trajectory_modifiers": {
        "split_particles": {"interval": _EVERY, "probability": _CHANCE, "statuses": _KINDS, "min_age": Param(float, 0.0), "max_age": Param(float, float("inf"))},
        "cull_particles": {"interval": _EVERY, "probability": _CHANCE, "statuses": Param(list, ["moving", "on_bottom"])}, "cull_rate": {"rate": Param(float, 0.0, 0.0)},
        "settle_in_polygon": {"points": Param("points", required=True), "probability_of_settlement": _CHANCE, "settlement_duration": Param(float, 0.0, 0.0)}, "surface_float": {},
    },
}


def read_params(path: str) -> dict[str, Any]:
    """Parameters from a JSON or a YAML file, by its ending."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        return plain_yaml(text)


def plain_yaml(text: str) -> Any:
    """The part of YAML that parameter files use: maps and lists by indent, flow lists and maps, scalars, comments."""
    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def scalar(x: str) -> Any:
        x = x.strip()
        if x[:1] in "[{" and x:
            inner = re.sub(r"([\[{,]\s*)([A-Za-z_][\w .-]*)(\s*[:,\]}])", lambda m: m[0] if m[2].strip() in ("true", "false", "null") else f'{m[1]}"{m[2].strip()}"{m[3]}', x.replace("'", '"'))
            return json.loads(re.sub(r'([\[,:]\s*)([A-Za-z_][\w.-]*)(\s*[,\]}])', lambda m: m[0] if m[2] in ("true", "false", "null") else f'{m[1]}"{m[2]}"{m[3]}', inner))
        if x[:1] in "\"'" and x:
            return x[1:-1]
        words = {"true": True, "false": False, "null": None, "~": None, "": None}
        if x.lower() in words:
            return words[x.lower()]
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                continue
        return x

    def block(at: int, indent: int) -> tuple[Any, int]:
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out: Any = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                rest = lines[at][1][1:].strip()
                if not rest:
                    value, at = block(at + 1, lines[at + 1][0])
                elif re.match(r"[^\[{\"']+:(\s|$)", rest):
                    lines[at] = (indent + 2, rest)
                    value, at = block(at, indent + 2)
                else:
                    value, at = scalar(rest), at + 1
                out.append(value)
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == indent:
            key, _, rest = lines[at][1].partition(":")
            if rest.strip():
                out[scalar(key)], at = scalar(rest), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > indent or lines[at + 1][0] == indent and lines[at + 1][1].startswith("-")):
                out[scalar(key)], at = block(at + 1, lines[at + 1][0])
            else:
                out[scalar(key)], at = None, at + 1
        return out, at

    return block(0, lines[0][0])[0] if lines else {}
