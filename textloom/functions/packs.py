"""Domain packs: the words and thresholds that classifiers use.

The default pack has the values of a Spanish and English obstetrics corpus; another domain brings its own pack.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pack:
    """Lexicons and thresholds. Fixed values."""

    terms: tuple[str, ...] = (
        "aborto", "amenaza", "anemia", "anticoncepcion", "atencion", "cesarea", "contraccion", "contracciones", "anticonceptivo", "anticonceptivos",
        "control prenatal", "diagnostico", "diabetes gestacional", "dilatacion", "eclampsia", "endometrial", "embarazada", "embarazo",
        "emergencia obstetrica", "feto", "fetal", "gestacion", "gestacional", "gestante", "ginecologia", "ginecologico", "hemorragia", "hipertension",
        "infeccion", "lactancia", "magnesio", "materna", "materno", "mortalidad materna", "neonato", "obstetricia", "obstetrico", "parto", "placenta",
        "preeclampsia", "prenatal", "posparto", "puerperio", "recien nacido", "riesgo", "ruptura", "sangrado", "sulfato de magnesio",
        "trabajo de parto", "tratamiento", "utero", "vaginal", "amenorrea", "endometrio", "infertilidad", "menopausia", "ovulacion", "birth",
        "breastfeeding", "cesarean", "delivery", "fetus", "gestational", "hemorrhage", "hypertension", "labor", "maternal", "newborn", "obstetric",
        "obstetrics", "postpartum", "pregnancy", "pregnant", "risk management", "vaginal birth",
    )
    actions: tuple[str, ...] = (
        "administrar", "controlar", "derivar", "diagnosticar", "evaluar", "identificar", "indicar", "manejar", "monitorizar", "prevenir", "realizar",
        "recomendar", "tratar", "vigilar", "administer", "assess", "diagnose", "evaluate", "identify", "manage", "monitor", "prevent", "recommend",
        "refer", "treat",
    )
    drop_headings: tuple[str, ...] = ("referencias", "bibliografia", "bibliography", "conflicto de interes", "conflictos de interes", "financiamiento", "agradecimientos", "autores", "author contributions", "correspondencia")
    index_terms: tuple[str, ...] = ("indice", "tabla de contenido", "contenido", "sumario")
    credits: tuple[str, ...] = ("isbn", "copyright", "editorial")
    spanish: tuple[str, ...] = ("el", "la", "los", "las", "una", "para", "con", "embarazo", "gestacion", "mujer", "parto", "salud")
    english: tuple[str, ...] = ("the", "and", "with", "pregnancy", "women", "birth", "health", "guideline")
    sections: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "index": ("indice", "tabla de contenido", "contenido", "sumario", "lista de figuras", "lista de tablas"),
            "introduction": ("introduccion", "presentacion", "antecedentes", "justificacion"),
            "methodology": ("metodos", "metodologia", "diseno", "muestra", "estadistica", "analisis"),
            "clinical_content": ("resultados", "discusion", "hallazgos", "caso clinico", "presentacion del caso"),
            "recommendations": ("recomendaciones", "conclusiones", "sintesis", "resumen ejecutivo", "implicaciones"),
            "references": ("referencias", "bibliografia", "bibliographic", "references"),
            "appendix": ("anexo", "apendice", "anexos", "apendices", "material suplementario"),
            "glossary": ("glosario", "abreviaturas", "siglas", "terminos", "definiciones"),
        }
    )
    roles: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "navigation": ("indice", "tabla de contenido", "sumario", "pagina", "capitulo"),
            "background": ("introduccion", "antecedentes", "historia", "epidemiologia", "contexto"),
            "evidence": ("evidencia", "estudio", "estudios", "metaanalisis", "revision sistematica", "ensayo clinico", "cohorte", "caso control"),
            "recommendation": ("recomendacion", "recomendaciones", "sugerencia", "sugerencias", "indicacion", "contraindicacion", "grado a", "grado b", "grado c", "nivel i", "nivel ii", "nivel iii"),
            "procedure": ("procedimiento", "tecnica", "protocolo", "algoritmo", "pasos", "manejo", "tratamiento", "intervencion", "cirugia"),
            "diagnostic": ("diagnostico", "diagnostico diferencial", "criterios", "clasificacion", "estadificacion", "tamizaje", "screening", "prueba", "pruebas"),
            "treatment": ("tratamiento", "terapia", "farmacoterapia", "medicamento", "medicamentos", "dosis", "posologia", "administracion", "efectos adversos"),
            "administrative": ("agradecimiento", "financiamiento", "conflicto de interes", "autores", "correspondencia", "derechos reservados", "isbn", "issn", "copyright"),
        }
    )
    section_role: dict[str, str] = field(
        default_factory=lambda: {"index": "navigation", "introduction": "background", "methodology": "evidence", "clinical_content": "evidence", "recommendations": "recommendation", "references": "administrative", "appendix": "background", "glossary": "background"}
    )
    topics: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "hemorrhage": ("hemorragia", "sangrado", "sangrar", "perdida de sangre", "hematoma", "hematocrito", "transfusion"),
            "preeclampsia": ("preeclampsia", "eclampsia", "hipertension gestacional", "proteinuria", "edema", "convulsion", "magnesio"),
            "diabetes_gestational": ("diabetes gestacional", "glucosa", "hipoglucemia", "hiperglucemia", "insulina", "glicemia", "glicosilada", "hgba1c", "macrosomia"),
            "preterm_labor": ("parto prematuro", "trabajo de parto pretermino", "contracciones prematuras", "amenaza de parto prematuro", "tocolisis", "corticoides", "madurez fetal"),
            "infection": ("infeccion", "sepsis", "corioamnionitis", "endometritis", "fiebre", "puerperal", "antibiotico", "infeccion puerperal"),
            "cesarean": ("cesarea", "cesarean", "csection", "c section", "operacion cesarea", "parto cesareo"),
            "vaginal_birth": ("parto vaginal", "parto normal", "parto eutocico", "distocia", "prolapso", "episiotomia", "forceps", "ventosa"),
            "newborn_care": ("recien nacido", "neonato", "neonatal", "apgar", "reanimacion neonatal", "hipoxia", "ictericia"),
            "contraception": ("anticoncepcion", "planificacion familiar", "metodos anticonceptivos", "diu", "pildora", "pastilla", "esterilizacion", "vasectomia"),
            "menopause": ("menopausia", "climaterio", "terapia hormonal", "sustitucion hormonal", "soja", "isoflavonas", "osteoporosis"),
            "infertility": ("infertilidad", "esterilidad", "fecundacion", "fiv", "fertilizacion in vitro", "espermatozoide", "ovocito", "ovulacion"),
            "prenatal_care": ("control prenatal", "consulta prenatal", "primer trimestre", "segundo trimestre", "tercer trimestre", "ecografia", "screening prenatal", "tamizaje"),
            "postpartum": ("puerperio", "posparto", "lactancia", "mastitis", "depresion postparto", "puerperio inmediato"),
            "fetal_monitoring": ("feto", "fetal", "monitoreo fetal", "cardiotocografia", "ritmo fetal", "frecuencia cardiaca fetal", "biometria"),
            "labor_induction": ("induccion", "maduracion cervical", "prostaglandinas", "oxitocina", "amniotomia", "desgarro membranas"),
            "gynecologic_oncology": ("cancer ginecologico", "tumor", "neoplasia", "biopsia", "histologia", "cervix", "cervical", "vph", "hpv"),
            "ultrasound": ("ultrasonido", "ecografia", "doppler", "transvaginal", "morfologica", "nuchal translucency"),
            "genetics": ("genetica", "cariotipo", "mutacion", "creening genetico", "amniocentesis", "villosidad corial"),
        }
    )
    clinical_roles: tuple[str, ...] = ("evidence", "recommendation", "procedure", "diagnostic", "treatment")
    dropped_roles: tuple[str, ...] = ("navigation", "administrative", "excluded")


#: A pack whose words occur in the synthetic test tables, so that every branch is exercised.
SAMPLE = Pack(
    terms=("tion", "ing", "und", "que", "ver keit", "of the"),
    actions=("ent", "sch"),
    drop_headings=("the", "die"),
    index_terms=("able", "heit"),
    credits=("license", "copyright"),
    spanish=("de", "la", "que", "en"),
    english=("the", "and", "of", "is"),
    sections={"index": ("able",), "introduction": ("ungen", "tionre"), "methodology": ("keit",), "references": ("license",)},
    roles={"navigation": ("able", "heit"), "background": ("tion", "ung"), "evidence": ("the", "die", "que"), "procedure": ("ing", "sch", "la")},
    section_role={"index": "navigation", "introduction": "background", "methodology": "evidence", "references": "navigation"},
    topics={"a": ("hered", "ungver"), "b": ("tionth", "keitder"), "c": ("que de",), "d": ("and the",)},
)
