"""Options of a conversion, checked on the driver before anything runs."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, replace

from lodestrata.functions.dims import QUANTIZATION_SCALES, TRANSFER_SYNTAXES

SYNTAXES = {s[0] for s in TRANSFER_SYNTAXES}
PROFILES = {p[0] for p in QUANTIZATION_SCALES}


def default_profile(syntax: str) -> str:
    return "Lossy97" if syntax == "Htj2k" else "Lossless53"


@dataclass(frozen=True)
class ExportOptions:
    tile_size: int = 512
    jpeg_quality: int = 90
    transfer_syntax: str = "Htj2kLosslessRpcl"
    profile: str = "Lossless53"
    icc_policy: str = "srgb"
    uid_policy: str = "fresh"
    backend: str = "auto"
    validate_codec: bool = False
    decomposition_levels: int | None = None
    overwrite: bool = False
    source_device_decode: bool = False
    gpu_encode_inflight_tiles: int | None = None
    gpu_encode_memory_mib: int | None = None
    gpu_pipeline_depth: int | None = None
    gpu_row_batch_rows: int | None = None
    gpu_row_batch_target_tiles: int | None = None

    def validate(self) -> ExportOptions:
        rules = [
            (self.tile_size > 0, "tile size must be greater than zero"), (1 <= self.jpeg_quality <= 100, "JPEG quality must be 1 to 100"),
            (self.transfer_syntax in SYNTAXES, "unknown transfer syntax"), (self.profile in PROFILES, "unknown profile"),
            ((self.transfer_syntax == "Htj2k") == (self.profile != "Lossless53"), "lossy profiles go with Htj2k only, and it needs one"),
            (self.decomposition_levels is None or self.decomposition_levels > 0, "decomposition levels must be greater than zero"),
            (self.backend in ("auto", "cpu", "prefer_device", "require_device"), "unknown backend"), (self.uid_policy in ("fresh", "deterministic"), "unknown UID policy"),
            (self.icc_policy in ("error", "srgb", "p3", "omit"), "unknown colour profile policy"),
            *((v is None or v > 0, f"{n} must be greater than zero") for n, v in self.device_limits().items()),
        ]
        for holds, what in rules:
            if not holds:
                raise ValueError(what)
        return self

    def device_limits(self) -> dict[str, int | None]:
        """Limits of the device's encoder; None leaves them to it."""
        return {n: getattr(self, n) for n in ("gpu_encode_inflight_tiles", "gpu_encode_memory_mib", "gpu_pipeline_depth", "gpu_row_batch_rows", "gpu_row_batch_target_tiles")}

    def with_syntax(self, syntax: str) -> ExportOptions:
        """Another transfer syntax; the profile is set to its default."""
        return replace(self, transfer_syntax=syntax, profile=default_profile(syntax))


def preset(name: str) -> ExportOptions:
    """`fast_jpeg` or `lossless_review`."""
    if name == "fast_jpeg":
        return ExportOptions(transfer_syntax="JpegBaseline8Bit")
    if name == "lossless_review":
        return ExportOptions(uid_policy="deterministic")
    raise ValueError(f"no preset {name}")


def resolve_syntax(preset_name: str | None, explicit: str | None) -> str | None:
    """The syntax that was asked for; the fast JPEG preset allows no other. None leaves the choice to the sources."""
    if preset_name == "fast_jpeg":
        if explicit:
            raise ValueError("the fast JPEG preset sets the transfer syntax")
        return "JpegBaseline8Bit"
    return explicit


def decoder_command(template: str, source: str, target: str) -> list[str]:
    """Arguments of an external decoder: {input} and {output} are replaced; without them the input comes last. The program's path must be absolute."""
    parts = shlex.split(template)
    if not parts or not parts[0].startswith("/"):
        raise ValueError("the decoder must be an absolute path")
    filled = [p.replace("{input}", source).replace("{output}", target) for p in parts]
    return filled if filled != parts else [*parts, source]


def timeout_text(seconds: float) -> str:
    return f"{round(seconds * 1000)} ms" if seconds < 1 or seconds != int(seconds) else f"{int(seconds)} s"
