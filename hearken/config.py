"""Thresholds, sets and wordings of the conversation-risk engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

STAGES = ["CONTACTO", "ENGANCHE", "AISLAMIENTO", "LOGISTICA"]
_CATEGORIES = (
    "señal_debil redes_sociales_vector videojuegos_vector",
    "contenido_normalizado formalidad_deceptiva manipulacion_social oferta_economica presion_de_grupo reclutamiento señal_emoji",
    "aislamiento cambio_canal solicitud_informacion",
    "logistica_fisica slang_operativo",
)
STAGE_OF = {c: k for k, names in enumerate(_CATEGORIES) for c in names.split()}
RISKS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
WEAK = "señal_debil"
AGE_BANDS = ("under13", "13-15", "16-17", "adult")


def _factors(band: str) -> dict[str, float]:
    by = {
        "under13": "aislamiento 1.5 manipulacion_social 1.3 redes_sociales_vector 1.4 señal_emoji 1.3 solicitud_informacion 1.6 videojuegos_vector 1.5",
        "13-15": "aislamiento 1.3 redes_sociales_vector 1.2 solicitud_informacion 1.4 videojuegos_vector 1.3",
        "16-17": "aislamiento 1.15 solicitud_informacion 1.15",
        "adult": "formalidad_deceptiva 0.4 oferta_economica 0.5 reclutamiento 0.7 solicitud_informacion 0.6 videojuegos_vector 0.6",
    }[band].split()
    return {c: float(f) for c, f in zip(by[::2], by[1::2], strict=True)}


AGE_FACTOR = {band: _factors(band) for band in AGE_BANDS}


@dataclass(frozen=True)
class EngineConfig:
    high: float = 20.0
    critical: float = 25.0
    rules_critical: int = 2
    velocity_seconds: int = 300
    velocity_hits: int = 3
    velocity_bonus: float = 1.2
    chain_hours: int = 48
    isolation_days: int = 7
    concentration: float = 0.75
    min_directed: int = 2
    reciprocity: float = 0.6
    evasion_points: float = 2.0
    evasion_most: float = 6.0
    intents_needed: int = 3
    intents_bonus: float = 15.0
    intents_rule: str = "CR-013"
    intents_category: str = "manipulacion_social"
    max_messages: int = 2000
    head_messages: int = 500
    max_chars: int = 4000
    action: tuple[str, ...] = tuple("aislamiento cambio_canal formalidad_deceptiva logistica_fisica oferta_economica solicitud_informacion".split())
    coercive: tuple[str, ...] = ("aislamiento", "cambio_canal", "manipulacion_social")
    directed: tuple[str, ...] = tuple("aislamiento cambio_canal formalidad_deceptiva logistica_fisica oferta_economica reclutamiento solicitud_informacion".split())
    never_dampened: str = "aislamiento"
    imminent: str = "logistica_fisica"
    age_factor: dict[str, dict[str, float]] = field(default_factory=lambda: AGE_FACTOR, hash=False)
    #: What the protected minor is told, and why a plan was chosen; a deployment puts its own wording here.
    urgent_message: str = "Puede que alguien quiera ponerte en peligro: quédate donde estás, no digas dónde vives y busca ya a un adulto en quien confíes (088 o Te Protejo)."
    calm_message: str = "Algo de esta charla podría ser inseguro; puedes dejar de contestar y hablarlo con un adulto en quien confíes (088 o Te Protejo)."
    quiet_summary: str = "Sin señales de riesgo en el análisis local."
    alert_summary: str = "Señales deterministas de riesgo en el análisis local: siga el plan de intervención."


CONFIG = EngineConfig()


def age_band(value: object) -> str | None:
    """The value if it is a known band, else None."""
    return value if isinstance(value, str) and value in AGE_BANDS else None
