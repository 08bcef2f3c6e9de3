"""Checks of explanation texts against the evidence they were given.

All per row, over the whole text, with built-in string and array functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists.
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"(?iU)\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b"
PORT_MENTION = r"(?iU)\b(?:port(?:a|at|it|in|es)?|porti)\s*(?:nr\.?|numer|numri)?\s*[:#]?\s*(\d{1,5})\b"
NUMBER = r"\d+(?:[.,]\d+)?"
PAYLOAD_TERMS = [
    r"payload", r"permbajtj\w*\s+e\s+paketa\w*", r"përmbajtj\w*\s+e\s+paketa\w*",
    r"permbajtjen\s+e\s+trafikut", r"packet\s+capture", r"deep\s+packet",
    r"kodi\s+i\s+shfrytezimit", r"exploit\s+code", r"shell\s?code",
]
PROTOCOL_WORDS = [
    "HTTP", "HTTPS", "DNS", "SMTP", "IMAP", "POP3", "TELNET", "RDP", "SMB", "NTP", "SNMP",
    "LDAP", "TLS", "SSL", "ICMP", "ARP", "DHCP", "SIP", "MQTT",
]
DECISION_TERMS = {
    "ATTACK": ["attack", "sulm", "malinj", "keqdashës", "keqdashes", "i dyshimt", "i dyshimte"],
    "BENIGN": ["benign", "normal", "i padëmshëm", "i pademshem", "beninj"],
}
INCREASE_TERMS = [
    "rrit", "në favor", "ne favor", "shtyu", "shtyn", "më të larta", "me te larta", "e lartë",
    "e larte", "drejt sulmit", "pro sulmit", "increase", "higher", "toward attack",
]
DECREASE_TERMS = [
    "uli", "ulur", "ulet", "uleta", "ulën", "ulen", "kundër", "kunder", "më të ulëta",
    "me te uleta", "e ulët", "e ulet", "larg sulmit", "decrease", "lower", "against attack",
    "toward benign",
]
EVIDENCE_TERMS = ["feature", "matj", "vlera", "kontribut", "shap"]
CAUTION_TERMS = ["verifik", "analist", "pasigur", "kujdes", "duhet kontrolluar", "rekomand"]
PROVIDER_PREFIXES = {"claude": "claude"}
WINDOW_CHARS = 90
TOLERANCE = 1e-6


def mentions_any(lowered: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(t)) for t in terms])


def evidence_numbers(evidence: Column, confidence: Column, anomaly: Column | None = None,
                     anomaly_score: Column | None = None) -> Column:
    """Every number a text may cite: values and contributions, and their roundings.

    ``anomaly`` (value, baseline, contribution per feature) and ``anomaly_score`` count where given.
    """
    none = F.array().cast("array<double>")
    more = none if anomaly is None else F.coalesce(F.array_compact(F.flatten(F.transform(
        anomaly, lambda e: F.array(e["value"], e["baseline"], e["contribution"])))), none)
    given = F.concat(F.transform(evidence, lambda e: e["value"]),
                     F.transform(evidence, lambda e: e["contribution"]), more,
                     F.array_compact(F.array(confidence, confidence * 100)),
                     none if anomaly_score is None else F.array_compact(F.array(anomaly_score)))
    return F.array_distinct(F.flatten(F.transform(given, lambda x: F.array(
        x, *[F.bround(x, d) for d in range(4)]))))


def is_given(number: Column, numbers: Column) -> Column:
    return F.exists(numbers, lambda n: F.abs(n - number) <= TOLERANCE)


def _finding(kind: str, severity: str, matched: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), matched.alias("matched"))


def findings(text: Column, evidence_text: Column, numbers: Column) -> Column:
    """Things the text names that it cannot know: addresses, payload, ports, protocols.

    ``matched`` is the text's own wording; of a protocol that is its first mention.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")

    def every(pattern, group=0):
        return F.regexp_extract_all(text, F.lit(pattern), group)

    v4 = every(IPV4)
    v6 = F.when(F.contains(text, F.lit(":")), F.filter(
        every(IPV6), lambda m: ~F.regexp_like(m, F.lit(IPV4)))).otherwise(none)
    # most texts name no payload: one search tells, the single patterns then count
    payload = F.when(text.rlike("(?iU)" + "|".join(PAYLOAD_TERMS)), F.flatten(F.array(
        *[every(f"(?iU){t}") for t in PAYLOAD_TERMS]))).otherwise(none)
    ports = F.when(F.contains(F.lower(text), F.lit("port")), F.filter(
        every(PORT_MENTION), lambda p: ~is_given(F.regexp_extract(p, PORT_MENTION, 1).cast("double"), numbers))).otherwise(none)
    named = every(rf"(?iU)\b({'|'.join(PROTOCOL_WORDS)})\b", 1)
    spelled = F.transform(named, F.upper)
    first = F.filter(named, lambda w, i: F.array_position(spelled, F.upper(w)) == i + 1)
    words = F.filter(first, lambda w: ~F.contains(evidence_text, F.lower(w)))
    return F.concat(
        F.transform(F.concat(v4, v6), lambda m: _finding("ip_address_not_in_evidence", "high", m)),
        F.transform(payload, lambda m: _finding("payload_or_packet_content_claim", "high", m)),
        F.transform(ports, lambda m: _finding("port_not_in_evidence", "medium", m)),
        F.transform(words, lambda m: _finding("protocol_not_in_evidence", "medium", m)))


def uncited_numbers(text: Column, numbers: Column) -> Column:
    """Numbers of the text, 0 or at least 1, that the evidence does not hold."""
    def value(m):
        return F.replace(m, F.lit(","), F.lit(".")).cast("double")

    return F.filter(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda m: (
        (value(m) >= 1) | (value(m) == 0)) & ~is_given(value(m), numbers))


def direction_claims(lowered: Column, evidence: Column) -> Column:
    """Per evidence feature: mentioned, and whether the words around it fit its sign."""
    def near(e):
        name = F.lower(e["feature"])
        at = F.position(name, lowered)
        start = F.greatest(F.lit(1), at - WINDOW_CHARS)
        return F.when(at > 0, F.substr(lowered, start, at + F.length(name) + WINDOW_CHARS - start))

    windows = F.transform(evidence, lambda e: F.struct(
        e["feature"].alias("feature"), near(e).alias("window"),
        F.when(e["contribution"] > 0, "increases_attack").otherwise("decreases_attack").alias("expected")))
    flagged = F.transform(windows, lambda w: F.struct(
        w["feature"].alias("feature"), w["expected"].alias("expected"), w["window"].isNotNull().alias("mentioned"),
        mentions_any(w["window"], INCREASE_TERMS).alias("up"), mentions_any(w["window"], DECREASE_TERMS).alias("down")))
    return F.transform(flagged, lambda w: F.struct(
        w["feature"].alias("feature"), w["mentioned"].alias("mentioned"), w["expected"].alias("expected"),
        F.when(w["up"] & ~w["down"], "increases_attack").when(w["down"] & ~w["up"], "decreases_attack").alias("claim")))


def provider_of(model: Column) -> Column:
    lowered = F.lower(F.coalesce(model, F.lit("")))
    result = F.lit(None).cast("string")
    for prefix, provider in PROVIDER_PREFIXES.items():
        result = F.when(F.startswith(lowered, F.lit(prefix)), provider).otherwise(result)
    return result
