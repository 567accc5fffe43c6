"""Word lists of the feedback lexicon."""

# These lists define the lexicon features and must stay as they are.
POSITIVE = (
    "etkileyici", "güçlü", "yüksek", "başarı", "mükemmel",
    "olağanüstü", "üstün", "potansiyel", "hakimiyet", "dikkat çek",
)
NEGATIVE = (
    "ancak", "geliştir", "gerekiyor", "eksik", "ihtiyaç", "daha fazla", "düşük", "zayıf",
)
SKILL = (
    "sql", "backend", "frontend", "devops", "cloud",
    "makine öğren", "veri yapı", "portföy", "github",
)
STOPWORDS = (
    "ve", "ile", "bir", "bu", "için", "da", "de", "daha", "olan", "gibi",
)
CONTRAST = "ancak"
