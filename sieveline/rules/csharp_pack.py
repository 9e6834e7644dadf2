"""C# pack and the pack of the C# analysis service.  Ids, titles, severities, categories,
patterns, references, confidences and feature names are fixed values; descriptions and
recommendations are our own words."""

from .model import A01, A02, A03, A07, A08, Rule

RULES = (
    Rule("CS-SEC-001", "SQL Injection", "critical", "security",
         r"""(?:SqlCommand|ExecuteNonQuery|ExecuteReader|ExecuteScalar)\s*\([^)]*\+""",
         ("sqlcommand", "executenonquery", "executereader", "executescalar"),
         0.88, "CWE-89", A03,
         ("sql_concat_command", "sqlcommand_usage", "parameterized_query_absent",
          "user_input_present", "ef_core_usage"),
         "The text of a database command is concatenated.",
         "Add the values as command parameters."),
    Rule("CS-SEC-002", "Hardcoded Connection String / Credential", "high", "security",
         r'''(?:connectionString|password|Password|ApiKey|Secret)\s*=\s*"[^"]{8,}"''',
         ("connectionstring", "password", "apikey", "secret"), 0.80, "CWE-798", A07,
         ("hardcoded_connection_string", "credential_keyword", "env_var_usage",
          "key_vault_usage", "config_file_pattern"),
         "A credential is compiled into the assembly.",
         "Move it to configuration or a key vault."),
    Rule("CS-SEC-003", "Insecure Deserialization (BinaryFormatter)", "critical", "security",
         r"""\bBinaryFormatter\b""", ("binaryformatter",), 0.92, "CWE-502", A08,
         ("binary_formatter_usage", "untrusted_source", "json_alternative",
          "obsolete_api", "deserialization_risk"),
         "The formatter can run code chosen by the sender.",
         "Serialise to JSON or another data-only format."),
    Rule("CS-SEC-004", "Weak Cryptography (MD5/SHA1)", "high", "security",
         r"""MD5\.Create\(\)|SHA1\.Create\(\)|new\s+MD5CryptoServiceProvider|new\s+SHA1CryptoServiceProvider""",
         ("md5", "sha1"), 0.95, "CWE-327", A02,
         ("md5_sha1_usage", "sha256_alternative", "password_context",
          "security_context", "bcrypt_usage"),
         "Neither hash resists collisions.",
         "Move to SHA-256 or SHA-3."),
    Rule("CS-SEC-005", "Path Traversal", "high", "security",
         r"""(?:File\.Read|File\.Write|File\.Open|Path\.Combine)\s*\([^)]*Request\.\w+""",
         ("request.",), 0.78, "CWE-22", A01,
         ("file_operation_with_user_input", "path_validation_missing",
          "getfullpath_check", "root_dir_check"),
         "A path is taken from the request.",
         "Resolve the path and check that it stays below the allowed root."),
    Rule("CS-SEC-006", "XSS via Response.Write()", "high", "security",
         r"""Response\.Write\s*\([^)]*Request\.""", ("response.write",), 0.85, "CWE-79", A03,
         ("response_write_user_input", "html_encoding_absent", "razor_view_absent",
          "xss_context"),
         "Request data is written into the page unescaped.",
         "Encode it for HTML first."),
    Rule("CS-MAINT-001", "Empty catch Block", "medium", "maintainability",
         r"""catch\s*(?:\([^)]+\))?\s*\{\s*\}""", ("catch",), 0.90, "CWE-390", "",
         ("empty_catch_block", "exception_swallowed", "logging_absent"),
         "The exception disappears without a trace.",
         "Log it at least."),
    Rule("CS-MAINT-002", "TODO / FIXME Comment", "info", "maintainability",
         r"""//\s*(?:TODO|FIXME|HACK|XXX)\b""", ("todo", "fixme", "hack", "xxx"), 0.99, "", "",
         ("todo_comment", "fixme_comment", "comment_quality"),
         "A comment marks open work.",
         "Track it as an issue and resolve the comment."),
)

# The service numbers its rules on its own: some ids mean something else than above.
SERVICE_CONFIDENCE = 0.75
SERVICE_FEATURES = ("roslyn_rule_match",)
SERVICE_RULES = (
    Rule("CS-SEC-001", "SQL Injection", "critical", "security",
         r"""(?:SqlCommand|ExecuteNonQuery|ExecuteReader|ExecuteScalar)\s*\([^)]*\+""",
         ("sqlcommand", "executenonquery", "executereader", "executescalar"),
         SERVICE_CONFIDENCE, "CWE-89", "", SERVICE_FEATURES,
         "The text of a database command is concatenated.",
         "Add the values as command parameters."),
    Rule("CS-SEC-002", "BinaryFormatter (Insecure Deserialization)", "critical", "security",
         r"""\bBinaryFormatter\b""", ("binaryformatter",),
         SERVICE_CONFIDENCE, "CWE-502", "", SERVICE_FEATURES,
         "The formatter can run code chosen by the sender.",
         "Serialise to JSON or another data-only format."),
    Rule("CS-SEC-003", "Hardcoded Connection String / Credential", "high", "security",
         r'''(?:connectionString|password|Password|ApiKey|Secret)\s*=\s"[^"]{8,}"''',
         ("connectionstring", "password", "apikey", "secret"),
         SERVICE_CONFIDENCE, "CWE-798", "", SERVICE_FEATURES,
         "A credential is compiled into the assembly.",
         "Move it to configuration or a key vault."),
    Rule("CS-SEC-004", "Weak Cryptography (MD5 / SHA1)", "high", "security",
         r"""MD5\.Create\(\)|SHA1\.Create\(\)|new\s+MD5CryptoServiceProvider|new\s+SHA1CryptoServiceProvider""",
         ("md5", "sha1"), SERVICE_CONFIDENCE, "CWE-327", "", SERVICE_FEATURES,
         "Neither hash resists collisions.",
         "Move to SHA-256 or SHA-3."),
    Rule("CS-SEC-005", "Path Traversal", "high", "security",
         r"""(?:File\.Read|File\.Write|File\.Open|Path\.Combine)\s*\([^)]*Request\.\w+""",
         ("request.",), SERVICE_CONFIDENCE, "CWE-22", "", SERVICE_FEATURES,
         "A path is taken from the request.",
         "Resolve the path and check that it stays below the allowed root."),
    Rule("CS-SEC-006", "XSS via Response.Write()", "high", "security",
         r"""Response\.Write\s*\([^)]*Request\.""", ("response.write",),
         SERVICE_CONFIDENCE, "CWE-79", "", SERVICE_FEATURES,
         "Request data is written into the page unescaped.",
         "Encode it for HTML first."),
    Rule("CS-SEC-007", "Empty catch Block", "medium", "maintainability",
         r"""catch\s*(?:\([^)]+\))?\s*\{\s*\}""", ("catch",),
         SERVICE_CONFIDENCE, "CWE-390", "", SERVICE_FEATURES,
         "The exception disappears without a trace.",
         "Log it at least."),
    Rule("CS-MAINT-001", "TODO / FIXME Comment", "info", "maintainability",
         r"""//\s*(?:TODO|FIXME|HACK|XXX)\b""", ("todo", "fixme", "hack", "xxx"),
         SERVICE_CONFIDENCE, "", "", SERVICE_FEATURES,
         "A comment marks open work.",
         "Track it as an issue and resolve the comment."),
    Rule("CS-PERF-001", "String Concatenation in Loop", "medium", "performance",
         r"""\+\s*=\s*["'\w]""", ("+",), SERVICE_CONFIDENCE, "", "", SERVICE_FEATURES,
         "Growing a string step by step copies it each time.",
         "Append to a StringBuilder."),
)
