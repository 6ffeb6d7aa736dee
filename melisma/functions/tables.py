"""Fixed values of the text analysis, as they must be for results to agree."""

# The stop words of each language, after accents are taken off.
STOPWORDS = {
    "es": """
        el la los las un una unos unas a ante bajo cabe con contra de del desde durante en entre hacia hasta
        mediante para por segun sin sobre tras y o u pero sino aunque no si ya tambien ademas asi como donde
        cuando mientras despues antes ahora luego que quien cual cuyo yo tu ella ello nosotros vosotros ellos
        ellas me te se le les lo mi su mis tus sus ser estar tener haber hacer poder decir ir ver dar saber
        querer llegar pasar deber poner parecer mas menos muy mucho poco algo nada todo nadie alguien cada
        otro mismo gran buen mal tal tan cuanto porque pues entonces
    """.split(),
    "en": """
        the be to of and a in that have i it for not on with he as you do at this but his by from they we say
        her she or an will my one all would there their what so up out if about who get which go me when make
        can like time no just him know take people into year your good some could them see other than then now
        look only come its over think also back after use two how our work first well way even new want
        because any these give day most us
    """.split(),
    "fr": """
        le la les un une des du de et est sont dans pour par avec sans ou mais donc or ni car que qui dont
        quoi ce ces cet cette mon ton son ma ta sa mes tes ses notre votre leur nos vos leurs je tu il elle
        nous vous ils elles me te se avoir etre faire dire pouvoir aller voir vouloir venir falloir devoir
        croire savoir tenir vivre entendre parler
    """.split(),
    "pt": """
        a o as os um uma uns umas de do da dos das em no na nos nas por para com sem sobre entre depois antes
        durante embora porque portanto e ou mas nem contudo entretanto assim eu tu ele ela vos eles elas me te
        se lhe lhes meu teu seu minha tua sua nossa vossa isso aquilo este esta estes estas esse essa esses
        essas aquele aquela aqueles aquelas
    """.split(),
    "it": """
        il lo la l i gli le un uno una del dello della dei degli delle e ed o ma pero perche che chi cui dove
        quando come quale quanti quante questo quella questi quelle quegli quel io tu lui lei noi voi loro mi
        ti si ci vi ne li me te se ce ve avere essere fare andare venire potere volere dovere dire sapere
        stare dare
    """.split(),
}

# Words that tell a language, searched before accents are taken off. Ties go to the first.
CUES = {
    "es": "el la los las y o pero porque con sin más muy".split(),
    "en": "the and of to in for on with by at this that".split(),
    "fr": "le la les et de des pour dans avec sans est sont".split(),
    "pt": "a o as os e de do da para com por mais".split(),
    "it": "il la le e di del della per con senza che non".split(),
}
CUE_WORDS = 200
DEFAULT_LANGUAGE = "en"

# Suffix and replacement, in the order in which they are tried.
SUFFIXES = {
    "es": [("ando", "ar"), ("iendo", "er"), ("ado", "ar"), ("ido", "er"), ("aba", "ar"), ("aron", "ar"), ("ieron", "er"), ("es", ""), ("s", ""), ("n", ""), ("dad", ""), ("mente", "")],
    "en": [("ing", ""), ("ed", ""), ("ies", "y"), ("s", ""), ("er", ""), ("est", ""), ("tion", "t"), ("sion", "s"), ("ity", "")],
    "fr": [("ant", ""), ("ent", ""), ("er", ""), ("ir", ""), ("re", ""), ("tion", "t"), ("sion", "s"), ("able", ""), ("ible", ""), ("ette", ""), ("ique", "")],
    "pt": [("ando", "ar"), ("endo", "er"), ("indo", "ir"), ("ado", "ar"), ("ido", "er"), ("ava", "ar"), ("eva", "er"), ("iva", "ir"), ("s", ""), ("cao", "r"), ("vao", "r")],
    "it": [("ando", "ar"), ("endo", "er"), ("indo", "ir"), ("ato", "ar"), ("uto", "er"), ("ito", "ir"), ("ava", "ar"), ("eva", "er"), ("iva", "ir"), ("i", ""), ("o", ""), ("e", ""), ("a", "")],
}
LEAST_WORD, LEAST_STEM = 5, 3

# Accented letters and what stands for them.
ACCENTED, PLAIN = "áàâãéèêëíìîïóòôõúùûüçñý", "aaaaeeeeiiiioooouuuucny"
# Names of the languages in the console's detail view, and the code of a document without one.
LANGUAGE_NAMES = {"es": "Español", "en": "Inglés", "fr": "Francés", "pt": "Portugués", "it": "Italiano"}
UNKNOWN_LANGUAGE = "desconocido"
