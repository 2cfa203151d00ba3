"""H-22: labels of stored codes; a code that a table lacks keeps a text of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by domain and code.
LABELS = {
    "download_state": {0: "in_progress", 1: "complete", 2: "cancelled", 3: "interrupted", 4: "interrupted_network"},
    "download_danger": {
        0: "not_dangerous", 1: "dangerous_file", 2: "dangerous_url", 3: "dangerous_content", 4: "maybe_dangerous_content", 5: "uncommon_content", 6: "user_validated",
        7: "dangerous_host", 8: "potentially_unwanted", 9: "allowlisted_by_policy", 10: "async_scanning", 11: "blocked_password_protected", 12: "blocked_too_large",
        13: "sensitive_content_warning", 14: "sensitive_content_block", 15: "deep_scanned_safe", 16: "deep_scanned_opened_dangerous", 17: "prompt_for_scanning", 18: "blocked_unsupported_file_type",
    },
    "download_interrupt": {
        0: "none", 1: "file_failed", 2: "file_access_denied", 3: "file_no_space", 5: "file_name_too_long", 6: "file_too_large", 7: "file_virus_infected", 10: "file_transient_error", 11: "file_blocked",
        12: "file_security_check_failed", 13: "file_too_short", 14: "file_hash_mismatch", 15: "file_same_as_source", 20: "network_failed", 21: "network_timeout", 22: "network_disconnected",
        23: "network_server_down", 24: "network_invalid_request", 30: "server_failed", 31: "server_no_range", 32: "server_bad_content", 33: "server_unauthorized", 34: "server_cert_problem",
        35: "server_forbidden", 36: "server_unreachable", 37: "server_content_length_mismatch", 38: "server_cross_origin_redirect", 40: "user_canceled", 41: "user_shutdown", 50: "crash",
    },
    "visit_type": {1: "link", 2: "typed", 3: "bookmark", 4: "embed", 5: "redirect_permanent", 6: "redirect_temporary", 7: "download", 8: "framed_link", 9: "reload"},
    "hidden": {0: "visible", 1: "hidden"},
    "chromium_samesite": {-1: "unspecified", 0: "no_restriction", 1: "lax", 2: "strict"},
    "chromium_priority": {0: "low", 1: "medium", 2: "high"},
    "chromium_source_scheme": {0: "unset", 1: "non_secure", 2: "secure"},
    "firefox_samesite": {0: "None", 1: "Lax", 2: "Strict"},
    "firefox_scheme_map": {0: "unset", 1: "http_only", 2: "https_only", 3: "both"},
    "chromium_permission": {0: "default", 1: "allow", 2: "block", 3: "ask", 4: "session_only", 5: "detect_important_content"},
    "firefox_permission": {0: "unknown", 1: "allow", 2: "block", 3: "prompt", 8: "prompt", 9: "allow_session"},
    "firefox_permission_type": {
        "geo": "geolocation", "desktop-notification": "notifications", "camera": "camera", "microphone": "microphone", "speaker-selection": "speaker_selection", "midi": "midi", "midi-sysex": "midi_sysex",
        "persistent-storage": "persistent_storage", "indexedDB": "indexeddb", "storage-access": "storage_access", "cookie": "cookies", "3rdPartyStorage": "third_party_storage",
        "3rdPartyFrameStorage": "third_party_frame_storage", "popup": "popup", "focus-tab-by-prompt": "focus_tab", "fullscreen": "fullscreen", "pointerLock": "pointer_lock", "install": "install", "xr": "webxr",
        "autoplay-media": "autoplay", "autoplay-media-audible": "autoplay_audible", "autoplay-media-inaudible": "autoplay_inaudible", "https-only-load-insecure": "https_only_exception",
        "https-only-load-insecure-pbm": "https_only_exception_private", "canvas": "canvas_extraction", "screen": "screen_capture", "clipboard-read": "clipboard_read", "clipboard-write": "clipboard_write",
        "publickey-credentials-get": "webauthn", "file-handle-write": "file_write",
    },
    "expire_type": {0: "permanent", 1: "expiring", 2: "session", 3: "policy"},
    "signed_state": {-2: "broken", -1: "unknown", 0: "missing", 1: "preliminary", 2: "signed", 3: "system", 4: "privileged"},
    "block_list_type": {0: "URL", 1: "Domain", 3: "Field-specific", 4: "Pattern"},
    "profile_token_type": {
        0: "UNKNOWN_TYPE", 1: "NAME_FULL", 2: "NAME_FIRST", 3: "NAME_MIDDLE", 4: "NAME_LAST", 5: "NAME_MIDDLE_INITIAL", 6: "NAME_PREFIX", 7: "NAME_SUFFIX", 9: "EMAIL_ADDRESS",
        10: "PHONE_HOME_NUMBER", 11: "PHONE_HOME_CITY_CODE", 12: "PHONE_HOME_COUNTRY_CODE", 13: "PHONE_HOME_CITY_AND_NUMBER", 14: "PHONE_HOME_WHOLE_NUMBER",
        30: "ADDRESS_HOME_LINE1", 31: "ADDRESS_HOME_LINE2", 32: "ADDRESS_HOME_LINE3", 33: "ADDRESS_HOME_APT_NUM", 34: "ADDRESS_HOME_CITY", 35: "ADDRESS_HOME_STATE", 36: "ADDRESS_HOME_ZIP", 37: "ADDRESS_HOME_COUNTRY",
        51: "CREDIT_CARD_NAME_FULL", 52: "CREDIT_CARD_NUMBER", 53: "CREDIT_CARD_EXP_MONTH", 54: "CREDIT_CARD_EXP_2_DIGIT_YEAR", 55: "CREDIT_CARD_EXP_4_DIGIT_YEAR", 56: "CREDIT_CARD_EXP_DATE_2_DIGIT_YEAR",
        57: "CREDIT_CARD_EXP_DATE_4_DIGIT_YEAR", 58: "CREDIT_CARD_TYPE", 59: "CREDIT_CARD_VERIFICATION_CODE", 60: "ADDRESS_HOME_STREET_ADDRESS", 61: "ADDRESS_HOME_SORTING_CODE", 62: "ADDRESS_HOME_DEPENDENT_LOCALITY",
        63: "ADDRESS_HOME_SUBPREMISE", 64: "ADDRESS_HOME_PREMISE_NAME", 65: "ADDRESS_HOME_DEPENDENT_STREET_NAME", 66: "ADDRESS_HOME_STREET_NAME", 67: "ADDRESS_HOME_HOUSE_NUMBER", 68: "ADDRESS_HOME_FLOOR",
        77: "COMPANY_NAME", 78: "BIRTHDATE_DAY", 79: "BIRTHDATE_MONTH", 80: "BIRTHDATE_4_DIGIT_YEAR", 81: "IBAN_VALUE",
    },
    "content_preference": {
        "browser.content.full-zoom": "zoom", "browser.zoom.siteSpecific": "zoom", "media.autoplay.default": "autoplay", "media.autoplay.allow-muted": "autoplay_muted", "media.autoplay.ask-permission": "autoplay_ask",
        "permissions.default.camera": "camera_default", "permissions.default.microphone": "microphone_default", "permissions.default.geo": "geolocation_default", "permissions.default.desktop-notification": "notifications_default",
        "browser.download.lastDir": "downloads_last_dir", "browser.download.folderList": "downloads_folder_list", "browser.download.useDownloadDir": "downloads_use_dir", "network.http.referer.spoofSource": "referer_spoof",
        "privacy.trackingprotection.enabled": "tracking_protection", "privacy.donottrackheader.enabled": "do_not_track", "security.mixed_content.block_active_content": "mixed_content_block", "security.OCSP.enabled": "ocsp_enabled",
    },
    "icon_type": {0: "INVALID", 1: "FAVICON", 2: "TOUCH_ICON", 4: "TOUCH_PRECOMPOSED", 8: "WEB_MANIFEST_ICON"},
}
#: Domains whose unknown codes stay as they are, or get one label.
AS_THEY_ARE = ("firefox_permission_type", "content_preference")
DEFAULTS = {"expire_type": "permanent", "chromium_permission": "unknown"}
#: What stands before an unknown code, and the label of a null one, where they differ from the common rule.
PREFIXES = {"block_list_type": "Type ", "profile_token_type": "UNKNOWN_"}
NULLS = {"block_list_type": "Unknown"}
BROKEN = (-2, -1, 0)


def label(domain: str, code: Column) -> Column:
    """H-22a to H-22j: the label of a code; null for a null code but where NULLS has one."""
    text = code.cast("string")
    known = F.coalesce(*[F.when(text == str(k), v) for k, v in LABELS[domain].items()])
    rest = text if domain in AS_THEY_ARE else F.lit(DEFAULTS[domain]) if domain in DEFAULTS else F.concat(F.lit(PREFIXES.get(domain, "unknown_")), text)
    return F.when(code.isNotNull(), F.coalesce(known, rest)).otherwise(F.lit(NULLS.get(domain)))


def icon_flags(code: Column) -> Column:
    """H-22h: the label of an icon type, or of all flags in it by ascending bit."""
    bits = [F.when(code.bitwiseAND(F.lit(k)) != 0, v) for k, v in LABELS["icon_type"].items() if k]
    named = F.nullif(F.concat_ws("|", *bits), F.lit(""))
    return F.when(code == 0, LABELS["icon_type"][0]).when(code.isNotNull(), F.coalesce(named, F.concat(F.lit("UNKNOWN_"), code.cast("string"))))


def unsigned_or_broken(state: Column) -> Column:
    """H-22g."""
    return F.coalesce(state.isin(*BROKEN), F.lit(False))
