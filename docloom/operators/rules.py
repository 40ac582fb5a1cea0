"""House style as data: rules, limits and fields from a mapping or a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, field

from docloom.operators.lint import Rule

# Sections of the file, the kind and severity of their rules, the field of a rule's suggestion, and messages that the file doesn't give.
FORBIDDEN, FIRST_PERSON, TONE, LIMITS, FIELDS = "palabras_prohibidas", "primera_persona", "tono", "reglas", "estructura_conclusion"
TONES = {"expresiones_a_cuestionar": "tone", "adjetivos_a_cuestionar": "adjective"}
MESSAGES = {
    "forbidden": "Término no permitido en informes.",
    "first_person": "El informe se redacta en impersonal.",
    "tone": "Expresión a cuestionar (tono negativo o rotundo): valorar una fórmula más precisa y constructiva si es fiel al contenido.",
    "adjective": "Adjetivo calificativo a cuestionar: solo si aporta precisión soportada por la evidencia.",
}
IMPERSONAL = "Reformular: «se ha observado…», «se recomienda…»."
LONGEST = 45


@dataclass(frozen=True)
class Style:
    """rules in the order in which they are applied; words in a sentence; (field, description, required); valid levels."""

    rules: list[Rule]
    longest: int = LONGEST
    fields: list[tuple[str, str, bool]] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)


def from_config(config: dict) -> Style:
    """The style of a mapping as the file holds it; what is missing is empty. A rule without a term, or a term that isn't text, is an error."""

    def rule(term: object, **more: str) -> Rule:
        if not isinstance(term, str) or not term.strip():
            raise ValueError(f"a rule's term must be text: {term!r}")
        return Rule(term, **{k: v or "" for k, v in more.items()})

    found = [rule(r.get("termino"), kind="forbidden", severity="error", message=r.get("motivo") or MESSAGES["forbidden"], suggestion=r.get("sugerencia")) for r in config.get(FORBIDDEN) or []]
    found += [rule(t, kind="first_person", severity="error", message=MESSAGES["first_person"], suggestion=IMPERSONAL) for t in config.get(FIRST_PERSON) or []]
    tone = config.get(TONE) or {}
    found += [rule(r.get("termino"), kind=kind, severity="warning", message=MESSAGES[kind], suggestion=r.get("alternativa")) for key, kind in TONES.items() for r in tone.get(key) or []]
    limits = config.get(LIMITS) or {}
    fields = [(f["campo"], f.get("descripcion") or "", bool(f.get("requerido", True))) for f in config.get(FIELDS) or []]
    return Style(found, int(limits.get("longitud_maxima_frase", LONGEST)), fields, list(limits.get("niveles_riesgo_validos") or []))


def load(text: str) -> Style:
    """The style of a YAML text; needs PyYAML."""
    import yaml

    return from_config(yaml.safe_load(text) or {})
