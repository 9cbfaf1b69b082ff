"""Scan configuration: allow list, build tools, limits, weights and thresholds.

The configuration is small and lives on the driver. Jobs take it either as literals
(domains, thresholds) or as frames (``weights_frame``, ``allow_domains_frame``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tarsift import fixed_values as fv


@dataclass(frozen=True)
class ScanConfig:
    allow_domains: tuple[str, ...] = tuple(fv.ALLOW_DOMAINS)
    build_tools: tuple[str, ...] = tuple(fv.BUILD_TOOLS)
    rule_weights: dict[str, int] = field(default_factory=lambda: dict(fv.RULE_WEIGHTS))
    thresholds: dict[str, int] = field(default_factory=lambda: dict(fv.THRESHOLDS))
    max_extract_bytes: int | None = None
    signature_max_mb: int = 999_999
    big_js_bytes: int = fv.BIG_JS_BYTES
    high_entropy: float = fv.HIGH_ENTROPY
    # None measures whole files; a number only so many bytes of their heads.
    entropy_sample_bytes: int | None = None
    # None reports every long base64 run of a file; a number only the first ones.
    max_blobs: int | None = None
    # True gives the documented downgrade of plain build hooks; the default keeps the
    # shipped behaviour, in which it never applies.
    strict_benign: bool = False
    # True looks for executable magics in every file, not only in the routed suffixes.
    magic_in_all_files: bool = False
    user_weights: dict[str, int] = field(default_factory=dict)

    def with_(self, **changes) -> "ScanConfig":
        return replace(self, **changes)


def config_from_mapping(doc: dict | None, env_max_extract_bytes: int = 0) -> ScanConfig:
    """Build the effective configuration from a parsed settings document.

    ``doc`` of None means "no settings at all", which has thresholds of its own.
    """
    if doc is None:
        return ScanConfig(
            allow_domains=tuple(fv.FALLBACK_ALLOW_DOMAINS),
            build_tools=tuple(fv.FALLBACK_BUILD_TOOLS),
            rule_weights={},
            thresholds=dict(fv.NO_CONFIG_THRESHOLDS),
            max_extract_bytes=_positive(env_max_extract_bytes),
        )
    analysis = doc.get("analysis") or {}
    scoring = doc.get("scoring") or {}
    domains = analysis.get("allow_domains", fv.FALLBACK_ALLOW_DOMAINS)
    if not analysis.get("flag_if_url_not_in_allowlist", True):
        domains = []
    tools = (analysis.get("allowlist") or {}).get("build_tools") or fv.FALLBACK_BUILD_TOOLS
    try:
        cap = int(analysis.get("max_extract_bytes") or 0)
    except (TypeError, ValueError):
        cap = 0
    signatures = analysis.get("yara") or {}
    return ScanConfig(
        allow_domains=tuple(domains),
        build_tools=tuple(tools),
        rule_weights=dict(scoring.get("rule_weights") or {}),
        thresholds=dict(scoring.get("thresholds") or fv.FALLBACK_THRESHOLDS),
        max_extract_bytes=_positive(cap) or _positive(env_max_extract_bytes),
        signature_max_mb=int(signatures.get("max_file_size_mb", 10)),
    )


def load_config(path: str, **kwargs) -> ScanConfig:
    """Read a YAML (or JSON) settings file on the driver; an unreadable one means None."""
    try:
        import yaml

        with open(path, encoding="utf-8") as handle:
            doc = yaml.safe_load(handle) or {}
    except Exception:
        doc = None
    return config_from_mapping(doc, **kwargs)


def _positive(value: int | None) -> int | None:
    return value if value and value > 0 else None


# The variants a finding can be weighted by: a severity or a confidence, "" for any.
WEIGHT_SCHEMA = "rule string, variant string, weight int"


def weight_rows(config: ScanConfig) -> list[tuple[str, str, int]]:
    """Effective weight per rule. ``variant`` is "" unless the weight depends on it."""
    given = config.rule_weights

    def w(key: str, default: int = 0) -> int:
        return int(given.get(key, default))

    network, hook, env = w("network_ioc"), w("lifecycle_exec"), w("env_access")
    chain = max(network, env) + hook + 1
    plain = {
        "lifecycle_script": hook,
        "suspicious_pattern": w("suspicious_strings"),
        "minified_long_lines": w("suspicious_strings"),
        "big_base64_blob": w("obfuscation"),
        "high_entropy_blob": w("obfuscation"),
        "has_bin": w("new_bin_added"),
        "url_in_code": network,
        "net_client_usage": network,
        "url_outside_allowlist": max(network, 1) + 1,
        "env_snoop": env,
        "webpack_bundle": w("packed_bundle"),
        "large_js": w("packed_bundle"),
        "ci_evasion": w("ci_evasion"),
        "c2_webhook": w("c2_webhook"),
        "writes_outside_pkg": w("writes_outside_pkg"),
        "writes_outside_pkg_candidate": w("writes_outside_pkg"),
        "native_binary_present": w("native_payload"),
        "wasm_present": w("native_payload"),
        "native_fetcher_present": w("native_payload"),
        "native_fetcher_custom_url": w("native_payload"),
        "npmrc_present": w("npmrc_present"),
        "lockfile_present": w("lockfile_present"),
        "install_chain_risk": chain,
        "install_persistence_risk": chain,
        "phishing_form": max(w("c2_webhook"), network) + 2,
        "fake_captcha": network + 1,
        "external_cdn_load": network + 1,
        "iframe_embed": network + 1,
        "http_server": w("writes_outside_pkg"),
        "port_binding": w("writes_outside_pkg"),
        "script_download": network + hook,
        "typosquat_detected": w("typosquat", 8),
    }
    plain.update(config.user_weights)
    rows = [(rule, "", weight) for rule, weight in plain.items()]
    rows += [
        ("advanced_obfuscation", "high", w("advanced_obfuscation", 5)),
        ("advanced_obfuscation", "other", w("obfuscation", 3)),
        ("yara_match", "high", w("yara_match_high", 7)),
        ("yara_match", "medium", w("yara_match_medium", 4)),
        ("yara_match", "other", w("yara_match_low", 2)),
    ]
    return rows


def weights_frame(spark: SparkSession, config: ScanConfig) -> DataFrame:
    return spark.createDataFrame(weight_rows(config), WEIGHT_SCHEMA)


def allow_domains_frame(spark: SparkSession, config: ScanConfig) -> DataFrame:
    return spark.createDataFrame([(d,) for d in config.allow_domains], "domain string")


def thresholds_frame(spark: SparkSession, config: ScanConfig) -> DataFrame:
    rows = [(label, int(value)) for label, value in config.thresholds.items()]
    return spark.createDataFrame(rows, "label string, min_score int")


def build_tools_frame(spark: SparkSession, config: ScanConfig) -> DataFrame:
    return spark.createDataFrame([(p,) for p in config.build_tools], "pattern string")
