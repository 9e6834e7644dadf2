"""Java pack.  Ids, titles, severities, categories, patterns, references, confidences
and feature names are fixed values; descriptions and recommendations are our own words."""

from .model import A02, A03, A07, A08, Rule

RULES = (
    Rule("JAVA-SEC-001", "SQL Injection", "critical", "security",
         r"""(?:createQuery|createNativeQuery|prepareStatement|executeQuery)\s*\([^)]*\+""",
         ("createquery", "createnativequery", "preparestatement", "executequery"),
         0.87, "CWE-89", A03,
         ("sql_concat_in_query", "prepared_statement_absent", "user_input_present",
          "parameterized_query", "orm_usage"),
         "The text of a database statement is concatenated.",
         "Prepare the statement and bind its parameters."),
    Rule("JAVA-SEC-002", "Hardcoded Password / Credential", "high", "security",
         r'''(?:password|passwd|secret|apiKey|token)\s*=\s*"[^"]{6,}"''',
         ("password", "passwd", "secret", "apikey", "token"), 0.82, "CWE-798", A07,
         ("hardcoded_string_credential", "env_var_usage", "secrets_manager_usage",
          "credential_keyword", "decompilation_risk"),
         "A credential is compiled into the class.",
         "Read it from the environment or a secret store."),
    Rule("JAVA-SEC-003", "Insecure Deserialization", "critical", "security",
         r"""\bObjectInputStream\b.*\breadObject\s*\(|\.readObject\s*\(\)""",
         ("readobject",), 0.80, "CWE-502", A08,
         ("object_input_stream", "read_object_call", "untrusted_source",
          "deserialization_filter", "json_alternative"),
         "Native deserialisation can run code chosen by the sender.",
         "Filter the accepted classes or change the format."),
    Rule("JAVA-SEC-004", "Weak Random Number Generation", "medium", "security",
         r"""\bnew\s+Random\s*\(\)""", ("random",), 0.75, "CWE-338", A02,
         ("util_random_usage", "secure_random_absent", "security_context",
          "token_generation_context"),
         "The general purpose generator is predictable.",
         "Draw from SecureRandom where it matters."),
    Rule("JAVA-SEC-005", "Null Pointer Dereference Risk", "medium", "correctness",
         r"""\w+\.get\w*\(\)\.\w+\(""", (".get",), 0.55, "CWE-476", "",
         ("null_check_missing", "method_chaining", "optional_usage", "npe_risk"),
         "The result of a getter is used without a check.",
         "Check for null or go through Optional."),
    Rule("JAVA-SEC-006", "printStackTrace() in Production", "low", "maintainability",
         r"""\.printStackTrace\s*\(\)""", (".printstacktrace",), 0.88, "CWE-532", "",
         ("print_stack_trace", "logger_absent", "sensitive_info_exposure", "error_handling"),
         "The stack trace goes to the console.",
         "Hand the exception to the logger."),
    Rule("JAVA-MAINT-001", "Empty catch Block", "medium", "maintainability",
         r"""catch\s*\([^)]+\)\s*\{\s*\}""", ("catch",), 0.90, "CWE-390", "",
         ("empty_catch_block", "exception_swallowed", "logging_absent"),
         "The exception disappears without a trace.",
         "Log it at least."),
    Rule("JAVA-MAINT-002", "TODO / FIXME Comment", "info", "maintainability",
         r"""//\s*(?:TODO|FIXME|HACK|XXX)\b""", ("todo", "fixme", "hack", "xxx"), 0.99, "", "",
         ("todo_comment", "fixme_comment", "comment_quality"),
         "A comment marks open work.",
         "Track it as an issue and resolve the comment."),
)
