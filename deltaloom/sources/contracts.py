"""File contracts: the header line of each exchange file, all text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .csv_source import text_schema
from .sniff import read_header

# Columns of the exchange files.
CONTRACTS: dict[str, tuple[str, ...]] = {
    "01_subdomains": (
        "schema_ver", "program", "subdomain", "domain", "ip_address", "dns_type", "cname_target", "mx_priority", "txt_records", "certificate_issuer",
        "certificate_subject", "certificate_san", "certificate_valid_from", "certificate_valid_to", "certificate_fingerprint", "wildcard_detected",
        "source", "discovery_method", "timestamp",
    ),
    "02_probe": (
        "schema_ver", "program", "host", "url", "scheme", "port", "status_code", "content_type", "content_length", "response_time_ms", "title",
        "server_header", "x_powered_by", "location_header", "set_cookie_headers", "security_headers", "cdn_provider", "waf_detected", "waf_type",
        "robots_txt_length", "favicon_hash", "favicon_url", "screenshot_path", "technologies_detected", "error_message", "redirect_chain",
        "final_url", "timestamp",
    ),
    "03_headless": (
        "schema_ver", "program", "base_url", "discovered_url", "url_type", "method", "headers", "form_data", "spa_route", "xhr_endpoint",
        "fetch_endpoint", "websocket_endpoint", "service_worker_url", "manifest_url", "dom_element", "element_attributes", "javascript_function",
        "javascript_variable", "local_storage_key", "session_storage_key", "cookie_name", "error_message", "load_time_ms", "screenshot_path",
        "timestamp",
    ),
    "04_discovery": (
        "schema_ver", "program", "base_url", "discovered_path", "full_url", "method", "status_code", "content_length", "content_type",
        "response_time_ms", "directory_listing", "backup_file", "config_file", "log_file", "sensitive_file", "admin_panel", "api_endpoint",
        "upload_form", "login_form", "database_file", "source_code", "documentation", "test_file", "soft_404_detected", "interesting_headers",
        "file_extension", "mime_type", "last_modified", "etag", "security_headers", "error_page", "redirect_location", "timestamp",
    ),
    "05_jsintel": (
        "schema_ver", "program", "source_url", "js_file_path", "endpoint_url", "endpoint_method", "endpoint_parameters", "api_key_found",
        "secret_found", "token_found", "hardcoded_credential", "internal_domain", "internal_ip", "debug_info", "source_map_url", "function_name",
        "variable_name", "comment_text", "regex_pattern_matched", "secret_type", "confidence_score", "line_number", "context", "obfuscated",
        "deobfuscated_content", "timestamp",
    ),
    "06_api_catalog": (
        "schema_ver", "program", "api_base_url", "endpoint_path", "full_endpoint_url", "http_method", "parameters", "parameter_types",
        "required_parameters", "optional_parameters", "authentication_required", "authentication_type", "request_content_type",
        "response_content_type", "description", "tags", "deprecated", "rate_limited", "openapi_spec_url", "swagger_ui_url", "graphql_schema",
        "graphql_introspection", "api_version", "discovery_source", "example_request", "example_response", "timestamp",
    ),
    "07_api_findings": (
        "schema_ver", "program", "endpoint_url", "http_method", "vulnerability_type", "severity", "finding_description", "test_payload",
        "request_headers", "request_body", "response_status", "response_headers", "response_body", "response_time_ms", "idor_potential",
        "mass_assignment_possible", "rate_limit_bypass", "verb_tampering_success", "authentication_bypass", "information_disclosure",
        "error_disclosure", "debug_info_exposed", "sensitive_data_exposed", "poc_steps", "remediation_suggestion", "confidence_level",
        "false_positive_likely", "timestamp",
    ),
    "08_mobile_intel": (
        "schema_ver", "program", "apk_path", "package_name", "app_name", "app_version", "min_sdk_version", "target_sdk_version", "permissions",
        "url_found", "api_endpoint", "domain_found", "api_key_found", "secret_found", "hardcoded_credential", "certificate_pinning",
        "network_security_config", "backup_allowed", "debug_enabled", "obfuscated", "string_resource", "shared_preferences_key", "database_file",
        "log_statement", "vulnerability_type", "severity", "file_path", "line_number", "context", "decompiler_used", "timestamp",
    ),
    "09_changes": (
        "schema_ver", "program", "url", "change_type", "field_changed", "old_value", "new_value", "change_detected_at", "last_checked_at",
        "change_significance", "title_changed", "server_header_changed", "technology_changed", "certificate_changed", "certificate_field_changed",
        "favicon_changed", "favicon_hash_old", "favicon_hash_new", "content_hash_old", "content_hash_new", "status_code_changed", "redirect_changed",
        "new_subdomain", "new_endpoint", "removed_endpoint", "security_headers_changed", "waf_status_changed", "cdn_provider_changed",
        "error_message", "timestamp",
    ),
    "99_final_ranked": (
        "schema_ver", "program", "target_url", "target_type", "risk_score", "confidence_score", "severity_level", "finding_title",
        "finding_description", "vulnerability_types", "attack_surface", "technologies_detected", "interesting_files", "api_endpoints",
        "sensitive_endpoints", "authentication_bypasses", "potential_idor", "information_disclosure", "debug_info_exposed", "certificates_issues",
        "waf_cdn_status", "change_indicators", "mobile_app_issues", "aggregated_signals", "signal_breakdown", "scoring_factors",
        "remediation_priority", "poc_availability", "exploitation_complexity", "business_impact", "technical_impact", "discovery_methods",
        "source_modules", "last_verified", "first_discovered", "timestamp",
    ),
}


def contract_schema(name: str) -> StructType:
    return text_schema(CONTRACTS[name])


def contract_from_file(spark: SparkSession, path: str) -> StructType:
    """The contract that a header-only file states."""
    return text_schema(read_header(spark, path))


def missing_columns(df: DataFrame, name: str) -> list[str]:
    return [c for c in CONTRACTS[name] if c not in df.columns]


def conform(df: DataFrame, name: str) -> DataFrame:
    """The contract's columns in its order, all text; what ``df`` lacks is empty."""
    from pyspark.sql import functions as F

    return df.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in CONTRACTS[name]))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], contract_schema(name))
