"""Explanation features: weight, wording and context words.

Everything in this module is a fixed value that decides the numbers and sentences of an
explanation.  A positive weight raises the risk, a negative one lowers it; a feature that
is not listed weighs nothing.
"""

# Feature weights.
WEIGHTS = {
    "sql_string_concat": 0.38,
    "sql_format_string": 0.35,
    "fstring_in_sql": 0.30,
    "raw_execute_call": 0.14,
    "eval_call": 0.60,
    "exec_call": 0.55,
    "external_arg_passed": 0.17,
    "function_param_origin": 0.12,
    "os_system_call": 0.40,
    "shell_true_flag": 0.32,
    "user_input_present": 0.22,
    "user_input_source": 0.20,
    "user_input_concat": 0.25,
    "user_controlled_path": 0.22,
    "md5_hash_usage": 0.55,
    "sha1_hash_usage": 0.42,
    "pickle_loads_call": 0.48,
    "yaml_load_call": 0.38,
    "safe_loader_missing": 0.20,
    "hardcoded_string_assignment": 0.30,
    "hardcoded_secret_string": 0.45,
    "hardcoded_string_credential": 0.38,
    "credential_keyword": 0.18,
    "open_with_user_input": 0.28,
    "path_validation_missing": 0.20,
    "random_module_usage": 0.30,
    "debug_true_flag": 0.45,
    "flask_app_run": 0.15,
    "bare_except": 0.28,
    "broad_catch": 0.20,
    "mutable_default_arg": 0.32,
    "list_default": 0.25,
    "dict_default": 0.25,
    "todo_comment": 0.15,
    "fixme_comment": 0.20,
    "print_statement": 0.18,
    "string_concat_in_loop": 0.28,
    "inner_html_assignment": 0.42,
    "api_response_data": 0.21,
    "document_write_call": 0.38,
    "localstorage_sensitive_data": 0.32,
    "token_storage": 0.28,
    "wildcard_target_origin": 0.35,
    "postmessage_call": 0.18,
    "object_assign_call": 0.22,
    "json_parse_input": 0.18,
    "console_log_present": 0.15,
    "loose_equality": 0.12,
    "sql_concat_in_query": 0.36,
    "prepared_statement_absent": 0.20,
    "util_random_usage": 0.28,
    "binary_formatter_usage": 0.52,
    "response_write_user_input": 0.38,
    "object_input_stream": 0.30,
    "read_object_call": 0.28,
    "print_stack_trace": 0.22,
    "empty_catch_block": 0.30,
    "exception_swallowed": 0.25,
    "cyclomatic_complexity": 0.35,
    "branch_count": 0.20,
    "nesting_depth": 0.18,
    "function_length": 0.22,
    "subprocess_string_arg": 0.28,
    "decompilation_risk": 0.15,
    "debug_output": 0.15,
    "untrusted_source": 0.25,
    "untrusted_input": 0.22,
    "data_origin": 0.18,
    "compile_error": 0.45,
    "compiler_warning": 0.15,
    "roslyn_rule_match": 0.30,
    "parameterized_query": -0.10,
    "orm_usage": -0.12,
    "ef_core_usage": -0.12,
    "input_sanitization": -0.08,
    "input_validation": -0.08,
    "sandboxing_present": -0.09,
    "allowlist_check": -0.07,
    "bcrypt_present": -0.08,
    "salt_usage": -0.05,
    "sha256_alternative": -0.06,
    "env_var_usage": -0.10,
    "secrets_manager_usage": -0.12,
    "key_vault_usage": -0.12,
    "realpath_check": -0.09,
    "base_dir_check": -0.08,
    "secrets_module_absent": 0.18,
    "logging_module_absent": 0.10,
    "logging_absent": 0.12,
    "none_default_pattern": -0.10,
    "dom_purify_present": -0.09,
    "text_content_used": -0.06,
    "httponly_cookie_absent": 0.15,
    "specific_exception_missing": 0.18,
    "issue_tracker_reference": -0.05,
    "json_alternative": -0.08,
    "deserialization_filter": -0.10,
    "signature_verification": -0.08,
    "secure_random_absent": 0.18,
    "debug_false_alternative": -0.10,
    "env_var_control": -0.08,
    "subprocess_list_args": -0.10,
    "proto_key_check": -0.08,
    "hasown_property_check": -0.06,
    "logger_absent": 0.10,
    "test_coverage_risk": 0.12,
    "return_count": 0.10,
    "null_check_missing": 0.20,
    "optional_usage": -0.08,
}

# Wording of a feature in a report.
DISPLAY = {
    "compile_error": "Compiler reported an error at this line",
    "compiler_warning": "Compiler reported a warning at this line",
    "roslyn_rule_match": "Roslyn rule engine matched this line",
    "sql_string_concat": "SQL string concatenation detected",
    "sql_format_string": "SQL built with .format()",
    "fstring_in_sql": "F-string used inside SQL query",
    "raw_execute_call": "Raw cursor.execute() call",
    "eval_call": "eval() function called",
    "exec_call": "exec() function called",
    "external_arg_passed": "External argument passed",
    "function_param_origin": "Input originates from function parameter",
    "os_system_call": "os.system() invoked",
    "shell_true_flag": "shell=True flag present",
    "user_input_present": "Unvalidated user input in scope",
    "user_input_source": "Data sourced from user request",
    "user_input_concat": "User input concatenated into command",
    "user_controlled_path": "User-controlled file path",
    "md5_hash_usage": "hashlib.md5() used for sensitive data",
    "sha1_hash_usage": "hashlib.sha1() used (weak hash)",
    "pickle_loads_call": "pickle.loads() called",
    "yaml_load_call": "yaml.load() without SafeLoader",
    "safe_loader_missing": "SafeLoader not specified",
    "hardcoded_string_assignment": "Hardcoded string assigned to credential",
    "hardcoded_secret_string": "Hardcoded secret string detected",
    "hardcoded_string_credential": "Hardcoded credential in source",
    "credential_keyword": "Credential-related variable name",
    "open_with_user_input": "open() called with user-derived path",
    "path_validation_missing": "No path validation found",
    "random_module_usage": "random module used (not cryptographic)",
    "debug_true_flag": "debug=True flag set",
    "flask_app_run": "Flask app.run() in production code",
    "bare_except": "Bare except: clause",
    "broad_catch": "Broad exception catch",
    "mutable_default_arg": "Mutable default argument",
    "list_default": "List [] used as default argument",
    "dict_default": "Dict {} used as default argument",
    "todo_comment": "TODO comment in code",
    "fixme_comment": "FIXME comment in code",
    "print_statement": "print() statement present",
    "string_concat_in_loop": "String concatenation in loop body",
    "inner_html_assignment": "innerHTML assignment to DOM element",
    "api_response_data": "Data sourced from API response",
    "document_write_call": "document.write() called",
    "localstorage_sensitive_data": "Sensitive data stored in localStorage",
    "token_storage": "Auth token stored client-side",
    "wildcard_target_origin": "Wildcard (*) target origin in postMessage",
    "postmessage_call": "postMessage() called",
    "object_assign_call": "Object.assign() with parsed JSON",
    "json_parse_input": "JSON.parse() of external input",
    "console_log_present": "console.log() in production code",
    "loose_equality": "Loose == equality used",
    "sql_concat_in_query": "String concat in SQL query method",
    "prepared_statement_absent": "PreparedStatement not used",
    "util_random_usage": "java.util.Random used (not secure)",
    "binary_formatter_usage": "BinaryFormatter used (deprecated/insecure)",
    "response_write_user_input": "Response.Write() with user input",
    "object_input_stream": "ObjectInputStream in use",
    "read_object_call": "readObject() deserialization call",
    "print_stack_trace": "e.printStackTrace() in production",
    "empty_catch_block": "Empty catch block",
    "exception_swallowed": "Exception silently swallowed",
    "cyclomatic_complexity": "High cyclomatic complexity",
    "branch_count": "High branch count",
    "nesting_depth": "Deep nesting detected",
    "function_length": "Function exceeds length threshold",
    "subprocess_string_arg": "subprocess called with string (not list)",
    "decompilation_risk": "Code vulnerable to decompilation",
    "parameterized_query": "Parameterized query not used",
    "orm_usage": "ORM not used for database access",
    "input_sanitization": "No input sanitization found",
    "input_validation": "No input validation present",
    "sandboxing_present": "No sandbox or allowlist",
    "allowlist_check": "No allowlist validation",
    "bcrypt_present": "bcrypt not imported",
    "salt_usage": "No salt applied to hash",
    "sha256_alternative": "SHA-256 alternative not used",
    "env_var_usage": "Environment variable not used",
    "secrets_manager_usage": "Secrets manager not used",
    "key_vault_usage": "Key vault not configured",
    "realpath_check": "No realpath() validation",
    "base_dir_check": "Base directory not checked",
    "secrets_module_absent": "secrets module not imported",
    "logging_module_absent": "logging module not used",
    "logging_absent": "No logger configured",
    "none_default_pattern": "None-default pattern not used",
    "dom_purify_present": "DOMPurify not imported",
    "text_content_used": "textContent not used as alternative",
    "httponly_cookie_absent": "HttpOnly cookie not used",
    "specific_exception_missing": "Specific exception type missing",
    "issue_tracker_reference": "No issue tracker reference",
    "json_alternative": "JSON serialization not used",
    "deserialization_filter": "No deserialization filter applied",
    "signature_verification": "No signature verification",
    "secure_random_absent": "SecureRandom not used",
    "debug_false_alternative": "debug=False alternative not set",
    "env_var_control": "Environment variable control absent",
    "subprocess_list_args": "List arguments not used in subprocess",
    "proto_key_check": "__proto__ key check absent",
    "hasown_property_check": "hasOwnProperty check missing",
    "logger_absent": "Logger not configured",
    "test_coverage_risk": "Low test coverage risk",
    "null_check_missing": "Null check not present",
    "optional_usage": "Optional not used for null safety",
    "debug_output": "Debug output in production code",
    "untrusted_source": "Data from untrusted source",
    "untrusted_input": "Untrusted external input",
    "data_origin": "External data origin unverified",
    "password_context": "Used in authentication context",
    "security_context": "Used in security-sensitive context",
    "token_generation_context": "Used for token generation",
    "session_context": "Used in session management",
    "loop_context": "Operation inside a loop",
    "error_handling_quality": "Poor error handling",
    "npe_risk": "Null pointer exception risk",
    "method_chaining": "Method chaining without null check",
    "ef_core_usage": "EF Core not used for queries",
    "config_file_pattern": "Configuration file pattern absent",
    "client_side_code": "Secret exposed in client-side code",
    "backend_proxy_missing": "Backend proxy for secret not used",
    "string_entropy": "High-entropy string literal",
    "xss_reachability": "XSS reachability path detected",
    "data_sensitivity": "Sensitive data classification",
    "sensitive_data_in_message": "Sensitive data in message payload",
    "prototype_chain_access": "Prototype chain access detected",
    "parser_blocking": "Parser-blocking call",
    "xss_context": "XSS vulnerability context",
    "html_encoding_absent": "HTML encoding not applied",
    "razor_view_absent": "Razor view auto-encoding not used",
    "return_count": "High return statement count",
    "sensitive_data_in_print": "Potential sensitive data in print()",
    "data_size_indicator": "Large data volume indicator",
    "list_join_pattern": "list.join() pattern not used",
}

# Words that reveal a context around the flagged line.  ``need`` is the
# number of distinct words for full strength.  With ``with_line`` the flagged line itself
# is put in front of its surroundings before searching.  The text is lower-cased first.
SIGNALS = {
    "user_input": {"need": 3, "with_line": True, "words": (
        "request", "input(", "argv", "stdin", "form", "param", "query",
        "user_input", "username", "password", "body", "payload", "data")},
    "sanitization": {"need": 1, "with_line": True, "words": (
        "escape", "sanitize", "validate", "filter", "clean", "strip",
        "parameterized", "prepared", "encode", "htmlspecialchars", "safe")},
    "orm": {"need": 1, "with_line": True, "words": (
        "objects.filter", "objects.get", "queryset", "session.query",
        "repository", "dbset", "findby", "jpa", "entitymanager")},
    "crypto": {"need": 2, "with_line": True, "words": (
        "hash", "password", "token", "auth", "session", "login",
        "credential", "secret", "signature", "hmac", "jwt")},
    "loop": {"need": 1, "with_line": False, "words": (
        "for ", "while ", "foreach", ".map(", ".forEach(", ".each(")},
    "error_handling": {"need": 1, "with_line": False, "words": (
        "try:", "except", "catch(", "try {", "rescue", "begin/rescue")},
}

# Which signal measures a feature.  A leading "!" inverts it; every other
# feature counts as fully present.
FEATURE_SIGNAL = {
    "user_input_present": "user_input",
    "user_input_source": "user_input",
    "user_input_concat": "user_input",
    "user_controlled_path": "user_input",
    "input_sanitization": "sanitization",
    "input_validation": "sanitization",
    "path_validation_missing": "!sanitization",
    "orm_usage": "orm",
    "ef_core_usage": "orm",
    "password_context": "crypto",
    "security_context": "crypto",
    "token_generation_context": "crypto",
    "session_context": "crypto",
    "loop_context": "loop",
    "error_handling_quality": "error_handling",
}

# Fixed value: lines shown above the flagged one; below it there is one line less.
CONTEXT_LINES = 5
