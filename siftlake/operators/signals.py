"""The four signals of a candidate: name role, value morphology, file provenance, line context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.functions import vocab as V

_META = "struct<ecosystem:string,prefix:string,subtype:string,charset:string,length:int,entropy:double,has_real_password:boolean,password_entropy:double,encoding:string,note:string>"
_META_FIELDS = [f.split(":") for f in _META[7:-1].split(",")]


def syntactic_role(name: Column) -> Column:
    """struct(value, confidence, reasoning) of a variable name's role."""
    row = lambda v, c, r: F.struct(F.lit(v).alias("value"), F.lit(c).alias("confidence"), (r if isinstance(r, Column) else F.lit(r)).alias("reasoning"))
    name = F.coalesce(name, F.lit(""))
    cred, anti = T.strings(V.CREDENTIAL_ATOMS), T.strings(V.ANTI_ATOMS)

    def of(atoms: Column) -> Column:
        c = F.array_sort(F.filter(atoms, lambda a: F.array_contains(cred, a)))
        n = F.array_sort(F.filter(atoms, lambda a: F.array_contains(anti, a)))
        some = lambda x: F.size(x) > 0
        return (
            F.when(name == "", row("neutral", 0.5, "no variable name available"))
            .when(F.lower(F.replace(name, F.lit("-"), F.lit("_"))).isin(*V.CREDENTIAL_NAMES), row("strong_credential", 0.9, F.concat(F.lit("'"), name, F.lit("' is a known credential variable name"))))
            .when(some(c) & ~some(n), row("strong_credential", 0.8, F.concat(F.lit("contains credential terms: "), F.array_join(c, ", "))))
            .when(some(c), row("neutral", 0.4, F.concat(F.lit("ambiguous: cred=["), F.array_join(c, " "), F.lit("] anti=["), F.array_join(n, " "), F.lit("]"))))
            .when(some(n), row("anti_credential", 0.2, F.concat(F.lit("contains anti-credential terms: "), F.array_join(n, ", "))))
            .when(F.array_contains(atoms, "api"), row("weak_credential", 0.6, "'api' in name but no key/token/secret"))
            .otherwise(row("neutral", 0.5, F.concat(F.lit("no credential signal in '"), name, F.lit("'"))))
        )

    return T.let(T.split_name(name), of)


def _meta(**known) -> Column:
    return F.struct(*[F.coalesce(known[n], F.lit(None)).cast(t).alias(n) if n in known else F.lit(None).cast(t).alias(n) for n, t in _META_FIELDS])


def _morph(value: str, reason, **meta) -> Column:
    meta = {k: v if isinstance(v, Column) else F.lit(v) for k, v in meta.items()}
    return F.struct(F.lit(value).alias("value"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reasoning"), _meta(**meta).alias("meta"))


def morphology(value: Column, role: Column, prefixes: dict[str, str] | None = None) -> Column:
    """struct(value, reasoning, meta) of a value's shape; the first test that holds decides.

    `prefixes` adds custom prefixes to the known ones.
    """
    known = T.known_prefix(value, V.PREFIXES | (prefixes or {}))
    cred = role.isin("strong_credential", "weak_credential")
    n = F.octet_length(value)
    say = F.concat
    lit = F.lit

    def prefixed(p: Column) -> Column:
        rest = F.lower(F.substring(value, F.length(p["prefix"]) + 1, F.length(value)))
        base, ext = F.regexp_extract(rest, r"(?s)\A(.+)(\.[^.]*)\z", 1), F.regexp_extract(rest, r"(?s)\A(.+)(\.[^.]*)\z", 2)
        return (
            F.when(T.contains_any(rest, V.PLACEHOLDER_STEMS), _morph("template_placeholder", say(lit("known prefix '"), p["prefix"], lit("' but placeholder value '"), rest, lit("'"))))
            .when(T.looks_like_identifier(rest), _morph("human_typed", say(lit("prefix '"), p["prefix"], lit("' but remainder '"), rest, lit("' is an identifier, not a token"))))
            .when(ext.isin(*V.IDENTIFIER_FILE_EXTENSIONS) & T.looks_like_identifier(base), _morph("human_typed", say(lit("prefix '"), p["prefix"], lit("' but '"), rest, lit("' is a filename, not a token"))))
            .otherwise(_morph("prefixed_random", say(lit("matches known prefix '"), p["prefix"], lit("' -> "), p["ecosystem"]), ecosystem=p["ecosystem"], prefix=p["prefix"]))
        )

    password = F.regexp_extract(value, V.DB_PASSWORD, 1)
    real = ~F.lower(password).isin(*V.PLACEHOLDER_PASSWORDS)
    bare = F.lower(F.regexp_replace(value, "\\A[\"']+|[\"']+\\z", ""))
    dots = F.size(F.split(value, r"\.", -1)) - 1
    colons = F.size(F.split(value, ":", -1)) - 1
    jwt = (dots == 2) & value.startswith("eyJ") & value.rlike(r"\A(?:[A-Za-z0-9_-]+={0,2})?\.(?:[A-Za-z0-9_-]+={0,2})?\.(?:[A-Za-z0-9_-]+={0,2})?\z")
    hash_like = n.isin(*V.HASH_LENGTHS) & T.is_hex(value)
    space = value.contains(" ")
    e = T.entropy(value)
    e1 = F.format_string("%.1f", F.bround(e, 1))
    at = F.instr(value, "@")
    size = n.cast("string")
    random = (n >= 16) & (n <= 512) & T.fast_entropy_screen(value) & (e > 3.5)
    special = (n >= 8) & (n <= 20) & (role == "strong_credential") & value.rlike("[@!#$%&*]")
    key = value.contains("-----BEGIN") & value.contains("PRIVATE KEY")
    human = lambda subtype, reason: _morph("human_typed", reason, subtype=subtype)
    return (
        F.when(known.isNotNull(), T.let(known, prefixed))
        .when(T.starts_with_any(value, ["ssh-rsa ", "ssh-ed25519 ", "ssh-dss ", "ecdsa-sha2-"]), _morph("human_typed", "SSH public key (not a secret)"))
        .when(T.contains_any(value, ["-----BEGIN PUBLIC KEY", "-----BEGIN CERTIFICATE"]), _morph("human_typed", "public key or certificate (not a secret)"))
        .when(key, _morph("private_key", "contains private key PEM header"))
        .when(
            value.contains("://") & value.rlike(V.DB_SCHEME) & (password != ""),
            _morph("connection_string", say(lit("connection string with "), F.when(real, "real-looking").otherwise("placeholder"), lit(" password")), has_real_password=real, password_entropy=T.entropy(password)),
        )
        .when(jwt, _morph("jwt", "JWT structure (header.payload.signature)"))
        .when(bare.isin(*V.PLACEHOLDER_WORDS), _morph("template_placeholder", say(lit("matches known placeholder '"), bare, lit("'"))))
        .when(value.rlike(r"\A(?:[xX]{4,}|[.]{4,})\z"), _morph("template_placeholder", "placeholder pattern (repeated chars)"))
        .when(value.rlike(r"(?i)\Ayour[_-][^\n]*[_-]here\z"), _morph("template_placeholder", "placeholder pattern (your-*-here)"))
        .when(T.is_uuid(value), _morph("structured_random", "UUID format (8-4-4-4-12)", subtype="uuid"))
        .when(hash_like & T.repeats_block(value), _morph("structured_random", say(size, lit("-char hex with repeating pattern, not a real secret")), subtype="repeating_pattern", length=n))
        .when(hash_like & cred, _morph("machine_random", say(size, lit("-char hex but credential variable overrides hash classification")), charset="hex", length=n, entropy=e, note="hex string in credential-named variable -- NOT classified as hash"))
        .when(hash_like, _morph("structured_random", say(size, lit("-char hex string, likely hash/digest")), subtype="hash", length=n))
        .when((n > 1) & value.startswith("/") & ~space & ~value.contains("://"), human("file_path", say(lit("Unix file path (len="), size, lit(")"))))
        .when(value.startswith("./") | value.startswith("../"), human("relative_path", "relative file path"))
        .when(value.startswith("http://") | value.startswith("https://"), human("url", say(lit("HTTP URL (len="), size, lit(")"))))
        .when((dots >= 2) & value.rlike(r"\A[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\z"), human("domain", "domain-name structure"))
        .when(value.rlike(r"(?s)\A[^/]*\.[^/]*/.+\z") & ~space, human("domain_path", "domain/path reference"))
        .when((at > 1) & (F.octet_length(F.substring_index(value, "@", 1)) < n - 3) & F.substring(value, at + 1, F.length(value)).contains(".") & ~space, human("email", "email address"))
        .when((colons >= 4) & ~space, human("colon_id", "colon-separated identifier"))
        .when(T.is_base64_binary(value) & cred, _morph("machine_random", "base64 decodable but credential variable overrides encoded classification", charset="base64", length=n, entropy=e, note="base64 in credential-named variable -- NOT classified as encoded data"))
        .when(T.is_base64_binary(value), _morph("encoded_payload", "valid base64 that decodes to binary data", encoding="base64"))
        .when(random, _morph("machine_random", say(lit("machine-random (entropy="), e1, lit(", charset="), T.charset(value), lit(", len="), size, lit(")")), charset=T.charset(value), length=n, entropy=e))
        .when(special, _morph("machine_random", say(lit("short credential with special chars (len="), size, lit(", entropy="), e1, lit(") - likely password")), charset="password", length=n, entropy=e))
        .otherwise(_morph("human_typed", say(lit("appears human-typed (len="), size, lit(", entropy="), e1, lit(")"))))
    )


def file_provenance(path: Column) -> Column:
    """struct(value, confidence, reasoning): what kind of file a path is, and how likely it has secrets."""
    row = lambda v, c, r: F.struct(F.lit(v).alias("value"), F.lit(c).alias("confidence"), F.lit(r).alias("reasoning"))
    low = F.lower(path)
    name = T.base_name(low)
    ends = lambda xs: T.any_of(name.endswith(x) for x in xs)
    return (
        F.when(name.isin(*V.LOCK_FILES), row("build_artifact", 0.02, "lock file"))
        .when(T.contains_any(name, [".example", ".sample", ".template", ".dist", ".default"]), row("example_config", 0.05, "example config file"))
        .when(path.rlike(V.TEST_PATH), row("test", 0.15, "test file"))
        .when(ends([".md", ".rst", ".txt", ".adoc"]), row("documentation", 0.1, "documentation file"))
        .when(low.rlike(V.DOCS_PATH) | T.starts_with_any(name, ["readme", "contributing", "changelog"]), row("documentation", 0.1, "documentation directory/file"))
        .when(low.rlike(V.BUILD_PATH), row("build_artifact", 0.05, "build artifact / vendored dependency"))
        .when(((name == ".env") | name.rlike(r"\A\.env\.[a-z]+\z")) & ~T.contains_any(name, ["example", "sample"]), row("env_config", 0.85, "environment config file"))
        .when(name.isin("docker-compose.yml", "docker-compose.yaml"), row("env_config", 0.75, "Docker Compose file (may contain secrets)"))
        .when(ends([".tf", ".tfvars", ".hcl"]), row("iac", 0.7, "infrastructure-as-code"))
        .when(low.rlike(V.CI_PATH), row("cicd", 0.6, "CI/CD pipeline config"))
        .otherwise(row("source", 0.5, "application source code"))
    )


def _bounded(low: Column, word: str) -> Column:
    """Whether the first occurrence of a word stands between characters that aren't letters."""
    at = F.instr(low, word)
    before, after = F.substring(low, at - 1, F.lit(1)), F.substring(low, at + len(word), F.lit(1))
    return (at > 0) & ((at == 1) | ~before.rlike("[a-z]")) & ~after.rlike("[a-z]")


def line_context(line: Column) -> Column:
    """struct(adjustment, reasoning): comments, revocations and reads of the environment lower trust."""

    def of(s: Column) -> Column:
        low = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        comment = F.when(T.starts_with_any(s, V.COMMENT_MARKS), -0.3).otherwise(0.0)
        word = F.lit(None).cast("string")
        for w in reversed(V.REVOKE_WORDS):
            word = F.when(_bounded(low, w), F.lit(w)).otherwise(word)
        revoked = F.when(word.isNotNull(), -0.5).otherwise(0.0)
        rest = F.substring(low, F.instr(low, "do") + 2, F.length(low))
        do_not_use = _bounded(low, "do") & (F.instr(rest, "not") > 0) & F.substring(rest, F.instr(rest, "not") + 3, F.length(rest)).contains("use")
        at = F.instr(low, "old")
        old = (at > 0) & F.substring(low, at + 3, F.lit(1)).isin("_", " ", "\t") & ((at == 1) | ~F.substring(low, at - 1, F.lit(1)).rlike("[a-z]"))
        env = T.contains_any(s, V.ENV_IN_LINE) | s.rlike(r"\$[A-Z]")
        a1 = comment + revoked
        a2 = a1 + F.when((a1 > -0.5) & do_not_use, -0.5).otherwise(0.0)
        a3 = a2 + F.when((a2 > -0.5) & old, -0.5).otherwise(0.0)
        a4 = a3 + F.when((a3 > -0.5) & env, -0.8).otherwise(0.0)
        reasons = F.array_compact(
            F.array(
                F.when(comment < 0, "in comment"),
                F.concat(F.lit("revocation context: '"), word, F.lit("'")),
                F.when((a1 > -0.5) & do_not_use, "revocation context: 'DO NOT USE'"),
                F.when((a2 > -0.5) & old, "revocation context: 'old'"),
                F.when((a3 > -0.5) & env, "credential-processing code (env-var reference)"),
            )
        )
        return F.struct(a4.alias("adjustment"), F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("no special line context").alias("reasoning"))

    return T.let(T.blank_trim(line), of)
