"""JavaScript pack.  Ids, titles, severities, categories, patterns, references, confidences
and feature names are fixed values; descriptions and recommendations are our own words."""

from .model import A01, A02, A03, A07, A08, Rule

RULES = (
    Rule("JS-SEC-001", "Cross-Site Scripting (XSS) via innerHTML", "high", "security",
         r"""\.innerHTML\s*=(?!=)""", (".innerhtml",), 0.85, "CWE-79", A03,
         ("inner_html_assignment", "api_response_data", "dom_purify_present",
          "text_content_used", "user_input_source"),
         "Markup is assigned to an element without cleaning.",
         "Set the text content, or clean the markup first."),
    Rule("JS-SEC-001b", "XSS via document.write()", "high", "security",
         r"""\bdocument\.write\s*\(""", ("document.write",), 0.82, "CWE-79", A03,
         ("document_write_call", "user_input_source", "dom_manipulation_alternative",
          "parser_blocking", "xss_context"),
         "Markup is written into the document while it loads.",
         "Create the nodes through the DOM."),
    Rule("JS-SEC-002", "Dangerous eval() Usage", "critical", "security",
         r"""\beval\s*\(""", ("eval",), 0.96, "CWE-95", A03,
         ("eval_call", "external_arg_passed", "function_param_origin",
          "sandboxing_present", "allowlist_check"),
         "A string is run as a script.",
         "Look the operation up in a table instead."),
    Rule("JS-SEC-003", "Sensitive Data in localStorage", "medium", "security",
         r"""localStorage\.setItem\s*\([^,]*(?:token|auth|password|secret|key)""",
         ("localstorage.setitem",), 0.85, "CWE-312", A02,
         ("localstorage_sensitive_data", "token_storage", "httponly_cookie_absent",
          "xss_reachability", "data_sensitivity"),
         "Every script on the page can read the stored secret.",
         "Keep it in a cookie that scripts cannot read."),
    Rule("JS-SEC-004", "Prototype Pollution Risk", "medium", "security",
         r"""Object\.assign\s*\([^)]*JSON\.parse""", ("object.assign",), 0.72, "CWE-1321", A08,
         ("object_assign_call", "json_parse_input", "proto_key_check",
          "hasown_property_check", "prototype_chain_access"),
         "Parsed input is merged into an object key by key.",
         "Reject the keys that reach the prototype."),
    Rule("JS-SEC-005", "Hardcoded API Key or Secret", "critical", "security",
         r"""(?:api_?key|apikey|secret|token|password|auth)\s*[:=]\s*["\'][A-Za-z0-9+/=_\-]{16,}["\']""",
         ("api_key", "apikey", "secret", "token", "password", "auth"), 0.78, "CWE-798", A07,
         ("hardcoded_secret_string", "credential_keyword", "client_side_code",
          "backend_proxy_missing", "string_entropy"),
         "A secret is shipped to every visitor.",
         "Keep it on the server and call through an endpoint."),
    Rule("JS-SEC-006", "Insecure postMessage Target Origin", "medium", "security",
         r"""\.postMessage\s*\([^,]+,\s*["\'][*]["\']""", (".postmessage",), 0.90, "CWE-346", A01,
         ("wildcard_target_origin", "postmessage_call", "sensitive_data_in_message",
          "specific_origin_missing"),
         "The message is delivered to any origin.",
         "Name the receiving origin."),
    Rule("JS-MAINT-001", "console.log() in Production Code", "low", "maintainability",
         r"""\bconsole\.(?:log|debug|dir)\s*\(""", ("console.",), 0.80, "CWE-532", "",
         ("console_log_present", "debug_output", "sensitive_data_risk", "logging_library_absent"),
         "Output is left in the browser console.",
         "Remove it or log through a library with levels."),
    Rule("JS-MAINT-002", "=== vs == Comparison", "low", "correctness",
         r"""[^=!<>]==[^=]""", ("==",), 0.65, "", "",
         ("loose_equality", "type_coercion", "strict_equality_absent"),
         "The comparison converts types.",
         "Compare strictly."),
    Rule("JS-MAINT-003", "TODO / FIXME Comment", "info", "maintainability",
         r"""//\s*(?:TODO|FIXME|HACK|XXX|BUG)\b""",
         ("todo", "fixme", "hack", "xxx", "bug"), 0.99, "", "",
         ("todo_comment", "fixme_comment", "comment_quality"),
         "A comment marks open work.",
         "Track it as an issue and resolve the comment."),
)
