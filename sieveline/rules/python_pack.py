"""Python pack.  Ids, titles, severities, categories, patterns, references, confidences
and feature names are fixed values; descriptions and recommendations are our own words."""

from .model import A01, A02, A03, A05, A07, A08, Rule

RULES = (
    Rule("PY-SEC-001", "SQL Injection", "critical", "security",
         r"""(?:execute|cursor\.execute|db\.execute|conn\.execute)\s*\([^)]*(?:\+\s*\w+|\bformat\b|\bf["\']|\%\s*\w)""",
         ("execute",), 0.88, "CWE-89", A03,
         ("sql_string_concat", "user_input_present", "parameterized_query",
          "input_sanitization", "orm_usage", "raw_execute_call"),
         "The text of a database statement is put together from variables.",
         "Bind the values as query parameters."),
    Rule("PY-SEC-001b", "SQL Injection (String Formatting)", "critical", "security",
         r"""(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\b.*(?:\.format\(|f[\'"].*\{)""",
         (".format(", "f'", 'f"'), 0.82, "CWE-89", A03,
         ("sql_format_string", "fstring_in_sql", "parameterized_query",
          "input_sanitization", "orm_usage"),
         "A statement is filled in by string formatting.",
         "Bind the values as query parameters instead of formatting them in."),
    Rule("PY-SEC-002", "OS Command Injection", "critical", "security",
         r"""\bos\.system\s*\([^)]*(?:\+|\bformat\b|f[\'"])""",
         ("os.system",), 0.93, "CWE-78", A03,
         ("os_system_call", "shell_true_flag", "user_input_concat",
          "subprocess_list_args", "input_validation"),
         "A shell command line is assembled from variable parts.",
         "Start the program from an argument list without a shell."),
    Rule("PY-SEC-002b", "Subprocess Shell Injection", "high", "security",
         r"""\bsubprocess\.\w+\s*\([^)]*shell\s*=\s*True""",
         ("subprocess.",), 0.78, "CWE-78", A03,
         ("shell_true_flag", "subprocess_string_arg", "user_input_present",
          "subprocess_list_args", "input_validation"),
         "A child process is started through the shell.",
         "Leave the shell out and pass a list of arguments."),
    Rule("PY-SEC-003", "Code Injection via eval()", "critical", "security",
         r"""\beval\s*\(""", ("eval",), 0.92, "CWE-95", A03,
         ("eval_call", "external_arg_passed", "function_param_origin",
          "sandboxing_present", "allowlist_check"),
         "A string is evaluated as an expression.",
         "Parse literals only, or look the operation up in a table."),
    Rule("PY-SEC-003b", "Code Injection via exec()", "critical", "security",
         r"""\bexec\s*\(""", ("exec",), 0.90, "CWE-95", A03,
         ("exec_call", "external_arg_passed", "function_param_origin",
          "sandboxing_present", "allowlist_check"),
         "A string is executed as code.",
         "Call named functions instead."),
    Rule("PY-SEC-004", "Weak Cryptographic Hash (MD5)", "high", "security",
         r"""\bhashlib\.md5\b|MD5\s*\(""", ("md5",), 0.97, "CWE-916", A02,
         ("md5_hash_usage", "password_context", "bcrypt_present",
          "salt_usage", "sha256_alternative"),
         "MD5 offers no collision resistance.",
         "Take SHA-256 for integrity and a password hash for passwords."),
    Rule("PY-SEC-004b", "Weak Cryptographic Hash (SHA-1)", "medium", "security",
         r"""\bhashlib\.sha1\b""", ("hashlib.sha1",), 0.90, "CWE-327", A02,
         ("sha1_hash_usage", "password_context", "sha256_alternative",
          "security_context", "salt_usage"),
         "Collisions for SHA-1 are practical.",
         "Move to SHA-256 or SHA-3."),
    Rule("PY-SEC-005", "Hardcoded Secret / Credential", "high", "security",
         r"""(?:password|passwd|secret|api_key|apikey|token|auth|credential)\s*=\s*["\'][^"\']{6,}["\']""",
         ("password", "passwd", "secret", "api_key", "apikey", "token", "auth", "credential"),
         0.80, "CWE-798", A07,
         ("hardcoded_string_assignment", "credential_keyword", "env_var_usage",
          "secrets_manager_usage", "string_length"),
         "A credential is written into the source.",
         "Read it from the environment or a secret store."),
    Rule("PY-SEC-006", "Insecure Deserialization (pickle)", "critical", "security",
         r"""\bpickle\.loads?\s*\(""", ("pickle.load",), 0.85, "CWE-502", A08,
         ("pickle_loads_call", "untrusted_source", "signature_verification",
          "json_alternative", "data_origin"),
         "Unpickling can run code chosen by whoever wrote the bytes.",
         "Exchange data in a format that carries no code."),
    Rule("PY-SEC-007", "Unsafe YAML Deserialization", "high", "security",
         r"""\byaml\.load\s*\((?![^)]*SafeLoader)""", ("yaml.load",), 0.83, "CWE-502", A08,
         ("yaml_load_call", "safe_loader_missing", "untrusted_input",
          "yaml_safe_load_alternative", "data_origin"),
         "YAML is loaded with a loader that can build arbitrary objects.",
         "Use the safe loader."),
    Rule("PY-SEC-008", "Path Traversal", "high", "security",
         r"""\bopen\s*\([^)]*(?:\+\s*\w+|\.format\s*\(|f["\'])""",
         ("open",), 0.72, "CWE-22", A01,
         ("open_with_user_input", "path_validation_missing", "realpath_check",
          "base_dir_check", "user_controlled_path"),
         "A file name is assembled from variable parts and opened.",
         "Resolve the path and check that it stays below the allowed root."),
    Rule("PY-SEC-009", "Insecure Random Number Generation", "medium", "security",
         r"""\brandom\.(?:random|randint|choice|randrange|shuffle|sample)\s*\(""",
         ("random.",), 0.70, "CWE-338", A02,
         ("random_module_usage", "security_context", "secrets_module_absent",
          "token_generation_context", "session_context"),
         "The general purpose generator is predictable.",
         "Draw from the secrets module where it matters."),
    Rule("PY-SEC-010", "Flask Debug Mode Enabled", "high", "security",
         r"""\bapp\.run\s*\([^)]*debug\s*=\s*True""", ("app.run",), 0.95, "CWE-94", A05,
         ("debug_true_flag", "production_context", "env_var_control",
          "flask_app_run", "debug_false_alternative"),
         "The web server starts with its interactive debugger.",
         "Switch debugging by configuration and keep it off in production."),
    Rule("PY-MAINT-001", "Bare except Clause", "medium", "maintainability",
         r"""^\s*except\s*:""", ("except",), 0.92, "CWE-390", "",
         ("bare_except", "specific_exception_missing", "exception_logging",
          "error_handling_quality", "broad_catch"),
         "The handler also catches interrupts and interpreter exit.",
         "Name the exceptions that are expected."),
    Rule("PY-MAINT-002", "Mutable Default Argument", "medium", "correctness",
         r"""def\s+\w+\s*\([^)]*=\s*(?:\[\]|\{\}|list\(\)|dict\(\)|set\(\))""",
         ("def",), 0.88, "", "",
         ("mutable_default_arg", "list_default", "dict_default",
          "none_default_pattern", "function_def"),
         "One default object is shared by all calls.",
         "Default to None and create the object inside."),
    Rule("PY-MAINT-003", "TODO / FIXME Comment", "info", "maintainability",
         r"""#\s*(?:TODO|FIXME|HACK|XXX|BUG)\b""",
         ("todo", "fixme", "hack", "xxx", "bug"), 0.99, "", "",
         ("todo_comment", "fixme_comment", "issue_tracker_reference", "comment_quality"),
         "A comment marks open work.",
         "Track it as an issue and resolve the comment."),
    Rule("PY-MAINT-004", "print() Statement (Debug Leftover)", "low", "maintainability",
         r"""^\s*print\s*\(""", ("print",), 0.75, "CWE-532", "",
         ("print_statement", "logging_module_absent", "sensitive_data_in_print", "debug_context"),
         "Output goes straight to the console.",
         "Log at a fitting level."),
    Rule("PY-PERF-001", "String Concatenation in Loop", "medium", "performance",
         r"""\w+\s*\+=\s*["\'\w]""", ("+=",), 0.60, "", "",
         ("string_concat_in_loop", "loop_context", "list_join_pattern", "data_size_indicator"),
         "Growing a string step by step copies it each time.",
         "Collect the parts and join them once."),
    Rule("PY-CMPLX-001", "High Cyclomatic Complexity", "medium", "complexity",
         None, (), 0.85, "", "",
         ("cyclomatic_complexity", "branch_count", "nesting_depth",
          "function_length", "return_count"),
         "The function has more branches than the threshold of 10.",
         "Split it and flatten the conditions."),
)
