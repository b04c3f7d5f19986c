"""Settings documents: salvage, migrations, defaults, prompt lists.

A document is a JSON text. Fields of a schema are read one by one, so a bad
value costs its own field only; the document itself stays a VARIANT.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 2


@dataclass(frozen=True)
class Field:
    """A settings field: Spark type, default, its allowed values if it is an enumeration, and other stored values that stand for some of them.

    count: no negative number. optional: null is a value. parts: the fields (and those
    that may lack) of the records of a list or map of records, kept as VARIANT; null
    stands for the caller's defaults, which C3 merges.
    """

    name: str
    kind: str
    default: object
    allowed: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()
    count: bool = False
    optional: bool = False
    parts: tuple[tuple[str, str], ...] = ()
    lacking: tuple[tuple[str, str], ...] = ()

    @property
    def json_kinds(self) -> tuple[str, ...]:
        return {"boolean": ("BOOLEAN",), "string": ("STRING",), "bigint": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL"), "array<string>": ("ARRAY",), "map<string,string>": ("OBJECT",), "records": ("ARRAY",), "map of records": ("OBJECT",)}[self.kind]


def _flags(names: str, default: bool) -> tuple[Field, ...]:
    return tuple(Field(name, "boolean", default) for name in names.split())


STRING_MAP = "map<string,string>"
LEVELS = ("trace", "debug", "info", "warn", "error")
# Fields with their defaults and the names of their enumerations.
FIELDS = (
    Field("selected_model", "string", ""),
    Field("selected_language", "string", "auto"),
    Field("app_language", "string", "en"),
    Field("history_limit", "bigint", 5, count=True),
    Field("word_correction_threshold", "double", 0.18),
    Field("audio_feedback_volume", "double", 1.0),
    Field("hold_threshold_ms", "bigint", 300, count=True),
    Field("paste_delay_ms", "bigint", 60, count=True),
    Field("paste_delay_after_ms", "bigint", 60, count=True),
    Field("extra_recording_buffer_ms", "bigint", 0, count=True),
    Field("custom_words", "array<string>", None),
    Field("custom_filler_words", "array<string>", None, optional=True),
    Field("selected_microphone", "string", None, optional=True),
    Field("selected_channel", "bigint", None, count=True, optional=True),
    Field("clamshell_microphone", "string", None, optional=True),
    Field("selected_output_device", "string", None, optional=True),
    Field("external_script_path", "string", None, optional=True),
    Field("post_process_provider_id", "string", "openai"),
    Field("post_process_selected_prompt_id", "string", None, optional=True),
    Field("recording_retention_period", "string", "preserve_limit", ("never", "preserve_limit", "days_3", "weeks_2", "months_3")),
    Field("shortcut_activation", "string", "hold_or_toggle", ("toggle", "push_to_talk", "hold_or_toggle")),
    Field("model_unload_timeout", "string", "min_5", ("never", "immediately", "min_2", "min_5", "min_10", "min_15", "hour_1", "sec_15")),
    Field("transcribe_accelerator", "string", "auto", ("auto", "cpu", "gpu")),
    Field("ort_accelerator", "string", "auto", ("auto", "cpu", "cuda", "directml", "rocm")),
    Field("transcribe_gpu_device", "string", None, optional=True),
    Field("vad_backend", "string", "silero", ("silero", "earshot")),
    Field("overlay_style", "string", "live", ("none", "minimal", "live")),
    Field("overlay_position", "string", "bottom", ("top", "bottom"), (("none", "bottom"),)),
    Field("log_level", "string", "debug", LEVELS, tuple((str(k), level) for k, level in enumerate(LEVELS, 1))),
    Field("sound_theme", "string", "marimba", ("marimba", "pop", "custom")),
    Field("theme", "string", "system", ("system", "light", "dark")),
    Field("paste_method", "string", "ctrl_v", ("ctrl_v", "direct", "none", "shift_insert", "ctrl_shift_v", "external_script")),
    Field("clipboard_handling", "string", "dont_modify", ("dont_modify", "copy_to_clipboard")),
    Field("auto_submit_key", "string", "enter", ("enter", "ctrl_enter", "cmd_enter")),
    Field("typing_tool", "string", "auto", ("auto", "wtype", "kwtype", "dotool", "ydotool", "xdotool")),
    Field("keyboard_implementation", "string", ""),  # the names are the caller's
    Field("whats_new_last_seen_version", "string", ""),
    Field("settings_schema_version", "bigint", 0, count=True),
    Field("post_process_api_keys", STRING_MAP, None),
    Field("post_process_models", STRING_MAP, None),
    Field("bindings", "map of records", None, parts=tuple((n, "STRING") for n in ("id", "name", "description", "default_binding", "current_binding"))),
    Field("post_process_prompts", "records", None, parts=(("id", "STRING"), ("name", "STRING"), ("prompt", "STRING"))),
    Field("post_process_providers", "records", None, parts=(("id", "STRING"), ("label", "STRING"), ("base_url", "STRING")), lacking=(("allow_base_url_edit", "BOOLEAN"), ("models_endpoint", "STRING"), ("supports_structured_output", "BOOLEAN"))),
    *_flags("translate_to_english onboarding_completed audio_feedback start_hidden autostart_enabled always_on_microphone debug_mode auto_submit post_process_enabled mute_while_recording append_trailing_space experimental_enabled lazy_stream_close reliable_paste", False),
    *_flags("update_checks_enabled show_whats_new_on_update show_tray_icon filler_word_removal_enabled vad_enabled", True),
)


def parsed(content) -> Column:
    """The document as VARIANT, null if it is no JSON object."""
    v = F.try_parse_json(F.col(content) if isinstance(content, str) else content)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _stored(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def has_key(doc: Column, name: str) -> Column:
    return _stored(doc, name).isNotNull() & (F.schema_of_variant(_stored(doc, name)) != "VOID")


def _records_right(raw: Column, field: Field) -> Column:
    """Whether all records of a list or map have the fields that they must have, of the right types."""
    every = F.try_variant_get(raw, "$", "array<variant>" if field.kind == "records" else "map<string,variant>")
    records = every if field.kind == "records" else F.map_values(every)

    def right(record: Column) -> Column:
        kind = lambda name: F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant"))
        out = F.lit(True)
        for name, wanted in field.parts:
            out = out & F.coalesce(kind(name) == wanted, F.lit(False))
        for name, wanted in field.lacking:
            out = out & F.coalesce(kind(name).isin(wanted, *(["VOID"] if wanted == "STRING" else [])), F.lit(True))
        return out

    return F.forall(records, right)


def salvaged_field(doc: Column, field: Field) -> Column:
    """A field's stored value if it is of the right type (and allowed), else its default."""
    raw = _stored(doc, field.name)
    kind = F.schema_of_variant(raw)
    right = kind.startswith(field.json_kinds[0])
    for k in field.json_kinds[1:]:
        right = right | kind.startswith(k)
    if field.parts:
        return F.when(right & _records_right(raw, field), raw).alias(field.name)
    if field.kind == "array<string>":
        right = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    if field.kind == STRING_MAP:
        right = right & F.forall(F.map_values(F.try_variant_get(raw, "$", "map<string,variant>")), lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    if field.aliases and field.kind == "string":
        right = right | kind.startswith("BIGINT")
    value = F.when(right, F.try_variant_get(doc, f"$.{field.name}", field.kind))
    if field.count:
        value = F.when(value >= 0, value)
    if field.allowed:
        if field.name == "log_level":
            value = F.lower(value)
        for stored, meant in field.aliases:
            value = F.when(value == stored, meant).otherwise(value)
        value = F.when(value.isin(*field.allowed), value)
    if field.kind == "array<string>" and not field.optional:
        default = F.array().cast("array<string>")
    elif field.kind == STRING_MAP:
        default = F.create_map().cast(STRING_MAP)
    else:
        default = F.lit(field.default).cast(field.kind)
    return F.coalesce(value, default).alias(field.name)


def salvaged(docs: DataFrame, content: str = "content", fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """Docs with a column for each field."""
    return docs.withColumn("_doc", parsed(content)).select("*", *[salvaged_field(F.col("_doc"), f) for f in fields])


def migrated(docs: DataFrame) -> DataFrame:
    """Salvaged settings (with _doc, the stored document) after the migrations, which go by the absence of keys and the stored schema version."""
    doc = F.col("_doc")
    absent = lambda name: ~F.coalesce(has_key(doc, name), F.lit(False))
    text = lambda name: F.try_variant_get(doc, f"$.{name}", "string")
    ptt = F.when(F.schema_of_variant(_stored(doc, "push_to_talk")) == "BOOLEAN", F.try_variant_get(doc, "$.push_to_talk", "boolean"))
    stored = F.coalesce(F.try_variant_get(doc, "$.settings_schema_version", "bigint"), F.lit(0))
    ordinal = F.when(F.schema_of_variant(_stored(doc, "transcribe_gpu_device")) == "BIGINT", F.try_variant_get(doc, "$.transcribe_gpu_device", "bigint"))
    device = F.when(stored >= 2, F.col("transcribe_gpu_device"))
    first = F.when((stored < 1) & (ordinal > 0), "auto").otherwise(F.col("transcribe_accelerator"))
    return docs.withColumns({
        "onboarding_completed": F.when(absent("onboarding_completed"), F.col("selected_model") != "").otherwise(F.col("onboarding_completed")),
        "whats_new_last_seen_version": F.when(absent("whats_new_last_seen_version"), "").otherwise(F.col("whats_new_last_seen_version")),
        "shortcut_activation": F.when(absent("shortcut_activation") & ptt.isNotNull(), F.when(ptt, "push_to_talk").otherwise("toggle")).otherwise(F.col("shortcut_activation")),
        "transcribe_accelerator": F.when((first == "gpu") & device.isNull(), "auto").otherwise(first),
        "transcribe_gpu_device": device,
        "overlay_style": F.when(absent("overlay_style"), F.when(text("overlay_position") == "none", "none").otherwise("live")).otherwise(F.col("overlay_style")),
        "settings_schema_version": F.when(stored < SCHEMA_VERSION, F.lit(SCHEMA_VERSION).cast("bigint")).otherwise(stored),
    })


def merged_defaults(stored: DataFrame, defaults: DataFrame, key: str = "id", synced: tuple[str, ...] = ("supports_structured_output",)) -> DataFrame:
    """Stored entries, with synced fields from the defaults, and the defaults that are missing."""
    d = defaults.select(key, *[F.col(c).alias(f"_{c}") for c in synced])
    kept = stored.join(d, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in synced}).select(*stored.columns)
    return kept.unionByName(defaults.join(stored.select(key), key, "left_anti").select(*stored.columns))


def prompt_added(prompts, prompt_id, name, text) -> Column:
    """C4: an array of prompts (id, name, prompt) with one more."""
    p = F.col(prompts) if isinstance(prompts, str) else prompts
    return F.concat(p, F.array(F.struct(F.lit(prompt_id).alias("id"), F.lit(name).alias("name"), F.lit(text).alias("prompt"))))


def _must(test: Column, value: Column, message: str) -> Column:
    return F.when(test, value).otherwise(F.raise_error(F.lit(message)))


def prompt_updated(prompts, prompt_id: str, name: str, text: str) -> Column:
    """C4: a prompt with a new name and text; a missing id is an error."""
    p = F.col(prompts) if isinstance(prompts, str) else prompts
    new = F.struct(F.lit(prompt_id).alias("id"), F.lit(name).alias("name"), F.lit(text).alias("prompt"))
    return _must(F.exists(p, lambda x: x["id"] == prompt_id), F.transform(p, lambda x: F.when(x["id"] == prompt_id, new).otherwise(x)), f"no prompt {prompt_id}")


def prompt_deleted(prompts, prompt_id: str) -> Column:
    """C4: without a prompt; a missing id is an error, as is the last prompt."""
    p = F.col(prompts) if isinstance(prompts, str) else prompts
    rest = F.filter(p, lambda x: x["id"] != prompt_id)
    return _must((F.size(rest) < F.size(p)) & (F.size(rest) > 0), rest, f"can't delete prompt {prompt_id}")


def prompt_selection(prompts, chosen, deleted_id: str) -> Column:
    """C4: the chosen prompt after a deletion: the first that is left, if it was the deleted one."""
    p, c = (F.col(x) if isinstance(x, str) else x for x in (prompts, chosen))
    rest = F.filter(p, lambda x: x["id"] != deleted_id)
    return F.when(c == deleted_id, F.try_element_at(rest, F.lit(1))["id"]).otherwise(c)


def with_setting(docs: DataFrame, name: str, value: object) -> DataFrame:
    """One field set."""
    return docs.withColumn(name, F.lit(value).cast(docs.schema[name].dataType))
