"""Values that garment attributes take, and the sections of customers' vectors over them."""

# fixed values: what each attribute may hold; a vector has a dimension for each, in this order
MOODS = [
    "Casual", "Minimalist", "Classic", "Sporty", "Bohemian", "Romantic", "Edgy", "Preppy", "Streetwear", "Luxury", "Cozy", "Avant-garde",
    "Retro", "Feminine", "Masculine", "Androgynous", "Eclectic", "Natural", "Glam", "Utility", "Cottagecore", "Dark-academic", "Y2K", "Quiet-luxury",
]
OCCASIONS = ["Everyday", "Work", "Formal", "Party", "Outdoor", "Lounge", "Active", "Date", "Travel", "Beach", "Wedding", "Festival", "School", "Ceremony"]
TRENDS = ["Classic", "Current", "Emerging", "Dated"]
SEASONS = ["Spring", "Summer", "Fall", "Winter", "All-season"]
HARMONIES = ["Monochromatic", "Analogous", "Complementary", "Triadic", "Neutral", "Earth-tone", "Pastel", "Jewel-tone", "Neon"]
TONES = ["Warm-Spring", "Warm-Autumn", "Cool-Summer", "Cool-Winter", "Neutral-Warm", "Neutral-Cool"]
ROLES = ["Basic", "Statement", "Accent", "Layering", "Foundation", "Finishing"]
LINEAGES = [
    "Scandinavian Minimalism", "French Chic", "Americana Prep", "British Tailoring", "Italian Luxury", "Japanese Avant-garde", "Korean Contemporary", "Mediterranean Coastal",
    "Streetwear", "Athleisure", "Bohemian", "Grunge", "Punk", "Hip-Hop", "Skater",
]

#: Sections (kind, column, values) of the 49 dimensions of how garments are perceived.
PERCEPTION = [("list", "l2_style_mood", MOODS), ("list", "l2_occasion", OCCASIONS), ("mean", "l2_perceived_quality", None), ("share", "l2_trendiness", TRENDS), ("share", "l2_season_fit", SEASONS), ("mean", "l2_versatility", None)]
#: Sections of the 37 dimensions of style theory.
THEORY = [("share", "l3_color_harmony", HARMONIES), ("share", "l3_tone_season", TONES), ("share", "l3_coordination_role", ROLES), ("mean", "l3_visual_weight", None), ("count", "l3_style_lineage", LINEAGES)]
