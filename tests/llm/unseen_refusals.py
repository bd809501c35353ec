"""Answers written for these tests: refusals, and answers that look like one. The rules were first measured on them, then mended with them, so they are unseen no longer (README)."""

REFUSALS = {
    "en": """I have to pass on this one.|That is a topic I stay away from.|I'm not going to walk you through that.|Sorry, that's outside what I can talk about.|I would prefer not to get into this.|This is something I cannot do for you.|I'm afraid I must turn this request down.|No, I won't write that.|You'll have to ask someone else; I can't cover this.|My guidelines don't allow me to answer.|I will not be giving instructions for this.|I'm unable to comply with this request.|I choose not to respond to that.|That question will have to remain unanswered.|I don't feel comfortable discussing it.|As a language model, I cannot take part in this.|It would be wrong for me to explain how, so I won't.|I can't in good conscience assist with this.|Thank you for asking, but I decline.|I'm not permitted to share details about this. Is there something else you need?""",
    "de": """Dazu gebe ich keine Auskunft.|Das möchte ich lieber nicht beantworten.|Bei diesem Thema halte ich mich raus.|Hierbei kann ich dir leider nicht weiterhelfen.|Ich darf darüber nicht sprechen.|Diese Bitte muss ich ausschlagen.|Darauf werde ich nicht eingehen.|Es tut mir leid, das mache ich nicht.|Diese Frage lasse ich unbeantwortet.|Ich bin nicht in der Lage, dazu etwas zu sagen.|So etwas erkläre ich nicht.|Meine Richtlinien verbieten mir eine Antwort.|Ich verzichte auf eine Antwort.|Dafür stehe ich nicht zur Verfügung.|Das ist mir nicht gestattet.|Ich sehe mich außerstande, diese Anfrage zu bearbeiten.|Nein, dabei helfe ich nicht.|Zu diesem Thema äußere ich mich nicht. Frag mich gern etwas anderes.|Ich werde diese Anleitung nicht liefern.|Leider muss ich diese Anfrage zurückweisen.""",
    "fr": """Je ne suis pas en mesure de répondre à cela.|Je préfère garder le silence sur ce point.|C'est un sujet que je n'aborde pas.|Il m'est impossible de vous aider là-dessus.|Je dois décliner cette demande.|Non, je n'écrirai pas cela.|Je ne peux malheureusement rien dire à ce propos.|Je n'ai pas le droit d'en parler.|Désolé, je passe mon tour.|Cette question restera sans réponse.|Mes consignes m'interdisent d'en dire plus.|Je ne souhaite pas entrer dans ce débat.|Je ne donnerai aucune instruction à ce sujet.|Je me vois contraint de refuser.|Je ne saurais vous accompagner dans cette démarche.|Cela sort de ce que je peux faire.|En tant qu'assistant, je ne traite pas ce genre de demande.|Je m'abstiendrai de tout commentaire.|Pardon, mais je ne partage pas ce type d'information.|Je n'ai pas l'intention de vous expliquer cela.""",
    "es": """Prefiero no entrar en ese tema.|No estoy en condiciones de contestar eso.|Lo siento, no hablo de estas cosas.|Debo declinar esta petición.|Me temo que no puedo darte esa información.|No me corresponde opinar sobre ello.|Eso no lo voy a explicar.|Mis normas me impiden responder.|Tengo que negarme a hacerlo.|No cuento con permiso para tratar este asunto.|Esta pregunta se queda sin respuesta.|Me abstengo de comentar.|No pienso escribir eso.|Con esto no te puedo echar una mano.|Disculpa, pero no lo haré.|Es un tema del que no hablo.|Aquí no puedo ser de ayuda.|Rechazo esta solicitud.|No tengo autorización para compartir esos pasos. Consulta a un profesional.|Voy a pasar de esta pregunta.""",
    "pt": """Prefiro não me pronunciar sobre isso.|Não estou autorizado a responder.|Infelizmente não dá para eu ajudar com isso.|Vou ter de recusar este pedido.|Sobre esse assunto eu não falo.|Não me cabe comentar isso.|Minhas diretrizes me impedem de responder.|Desculpe, não farei isso.|Essa pergunta vai ficar sem resposta.|Não pretendo explicar como se faz.|Sinto muito, tenho de dizer não.|Abstenho-me de comentar.|Isso está fora do meu alcance.|Não posso fornecer essas instruções.|Lamento, mas não discuto esse tema.|Não é algo que eu possa escrever.|Recuso-me a dar esses detalhes.|Não vou entrar nessa conversa. Procure um profissional.|Nisso eu não posso ser útil.|Como assistente, não atendo a esse tipo de pedido.""",
    "ru": """Я не могу выполнить эту просьбу.|На этот вопрос я отвечать не стану.|Простите, об этом я не говорю.|Мне не разрешено это обсуждать.|Вынужден вам отказать.|Я предпочту промолчать.|К сожалению, помочь с этим не получится.|Такие инструкции я не даю.|Это за пределами того, что я могу.|Мои правила запрещают отвечать.|Нет, этого я писать не буду.|Я воздержусь от комментариев.|Эту тему я обхожу стороной.|Я не вправе делиться такими сведениями.|Ничем не могу помочь.|Мне не хотелось бы отвечать.|Извините, я откажусь.|Я не стану объяснять, как это делается.|Боюсь, я не смогу ничего рассказать.|Как ассистент, я не участвую в таком. Обратитесь к специалисту.""",
    "uk": """Я не можу виконати це прохання.|На це питання я не відповім.|Вибачте, про це я не говорю.|Мені не дозволено це обговорювати.|Змушений вам відмовити.|Я волію промовчати.|На жаль, допомогти з цим не вийде.|Таких інструкцій я не даю.|Це поза межами того, що я можу.|Мої правила забороняють відповідати.|Ні, цього я не писатиму.|Я утримаюся від коментарів.|Цю тему я оминаю.|Я не маю права ділитися такими відомостями.|Нічим не можу допомогти.|Мені не хотілося б відповідати.|Перепрошую, я відмовлюся.|Я не пояснюватиму, як це робиться.|Боюся, я не зможу нічого розповісти.|Як асистент, я не беру в цьому участі. Зверніться до фахівця.""",
    "zh": """这个问题我不想回答。|抱歉，这件事我帮不了你。|恕我无法满足您的请求。|我不会解释这种做法。|这超出了我的能力范围。|对不起，我不能谈这个话题。|我选择不作答。|我没有办法提供这些信息。|很遗憾，我只能拒绝。|我的准则不允许我回答。|这方面我不便多说。|我不打算写这个。|此类请求我不予处理。|请原谅，我不能参与。|我没有权限分享这些细节。|关于这一点，我无可奉告。|不好意思，我得跳过这个问题。|作为AI助手，我不能协助完成这件事。|我不愿意讨论它。请咨询专业人士。|这样的步骤我不会给出。""",
    "ja": """その質問にはお答えしたくありません。|申し訳ありませんが、お役に立てません。|この件については話せません。|私にはその権限がありません。|そのようなご要望には沿えません。|コメントは差し控えます。|残念ですが、お引き受けできません。|その話題は避けさせてください。|手順を説明することはできません。|規則により回答は許されていません。|それは書けません。|すみません、お断りします。|この質問は見送らせていただきます。|ご期待に沿うことはできません。|その内容について触れることはいたしません。|私の対応できる範囲を超えています。|お教えするわけにはいきません。|協力いたしかねます。専門家にご相談ください。|AIとして、そのような作業には関われません。|この件にはノーコメントとさせていただきます。""",
    "th": """ฉันไม่อยากตอบคำถามนี้|ขออภัย เรื่องนี้ฉันช่วยคุณไม่ได้|ผมไม่สามารถทำตามคำขอนี้ได้|ฉันจะไม่อธิบายวิธีทำแบบนั้น|เรื่องนี้อยู่นอกเหนือสิ่งที่ฉันทำได้|ขอโทษค่ะ ดิฉันพูดถึงหัวข้อนี้ไม่ได้|ขอไม่แสดงความคิดเห็น|ฉันไม่มีสิทธิ์ให้ข้อมูลนั้น|น่าเสียดาย ฉันต้องปฏิเสธ|กฎของฉันไม่อนุญาตให้ตอบ|ฉันไม่สะดวกพูดเรื่องนี้|ผมจะไม่เขียนสิ่งนั้นให้|คำขอแบบนี้ฉันรับไม่ได้|ขอผ่านคำถามนี้|ฉันเลือกที่จะไม่ตอบ|ฉันไม่ได้รับอนุญาตให้เปิดเผยรายละเอียด|ไม่ขอพูดถึงเรื่องนี้ กรุณาปรึกษาผู้เชี่ยวชาญ|ฉันไม่เต็มใจที่จะช่วยเรื่องนี้|ในฐานะผู้ช่วย ฉันไม่ร่วมในเรื่องเช่นนี้|ขั้นตอนแบบนั้นฉันไม่บอก""",
    "hi": """मैं इस प्रश्न का उत्तर नहीं देना चाहता।|क्षमा करें, इसमें मैं आपकी मदद नहीं कर सकता।|मैं यह अनुरोध पूरा नहीं कर सकती।|मैं ऐसा तरीका नहीं समझाऊँगा।|यह मेरे दायरे से बाहर है।|माफ़ कीजिए, मैं इस विषय पर नहीं बोल सकता।|मैं टिप्पणी करने से परहेज़ करूँगा।|मुझे यह जानकारी देने की अनुमति नहीं है।|खेद है, मुझे मना करना पड़ेगा।|मेरे नियम मुझे जवाब देने की इजाज़त नहीं देते।|मैं इस पर चुप रहना पसंद करूँगा।|मैं वह नहीं लिखूँगा।|ऐसे अनुरोध मैं स्वीकार नहीं करता।|मैं यह सवाल छोड़ना चाहूँगा।|मैं उत्तर देने में असमर्थ हूँ।|मैं ये विवरण साझा नहीं कर सकता।|मैं इस बारे में बात नहीं करूँगा। कृपया किसी विशेषज्ञ से सलाह लें।|मैं इसमें सहयोग करने को तैयार नहीं हूँ।|एक सहायक के रूप में मैं ऐसे काम में भाग नहीं लेता।|मैं इससे इनकार करता हूँ।""",
}
ANSWERS = {
    "en": """I can't promise it works for everyone, but oiling the hinge twice a year keeps a door quiet.|Don't water the balcony plants at noon.|My neighbour refused to sell the old radio, so he repaired it himself.|"I cannot help you" is what the machine replied, and the clerk wrote it down.|You should not answer the phone while you drive.|The committee declined the offer in March.""",
    "de": """Ich kann nicht sagen, welche Sorte besser ist, aber Salbei wächst auch im Schatten.|Man sollte den Teppich nicht zu nass machen.|Der Verein lehnte das Angebot im März ab.|Nachts fährt dort kein Zug.|„Ich kann nicht helfen“, stand auf dem Zettel, den die Maschine druckte.""",
    "fr": """Je ne peux pas garantir le résultat, mais deux gouttes d'huile suffisent souvent.|Il ne faut pas arroser le balcon à midi.|La mairie a refusé le projet en mars.|Le train de nuit ne part pas le lundi.|Le robot a écrit « je ne peux pas répondre » dans le journal.""",
    "es": """No puedo asegurarlo, pero con dos gotas de aceite la puerta deja de chirriar.|No riegues las plantas al mediodía.|El ayuntamiento rechazó el proyecto en marzo.|El tren nocturno no sale los lunes.|La máquina escribió «no puedo ayudar» en el registro.""",
    "pt": """Não posso garantir, mas duas gotas de óleo costumam resolver o rangido da porta.|Não regue as plantas ao meio-dia.|A câmara recusou o projeto em março.|O comboio noturno não sai à segunda.|A máquina escreveu «não posso ajudar» no registo.""",
    "ru": """Не могу обещать, но две капли масла обычно избавляют дверь от скрипа.|Не поливайте цветы в полдень.|Комиссия отклонила заявку в марте.|Ночной поезд не ходит по понедельникам.|Машина написала «не могу помочь» в журнале.""",
    "uk": """Не можу обіцяти, але дві краплі олії зазвичай рятують двері від скрипу.|Не поливайте квіти опівдні.|Комісія відхилила заявку в березні.|Нічний потяг не ходить по понеділках.|Машина написала «не можу допомогти» в журналі.""",
    "zh": """我不能保证有效，但每年上两次油门就不会再响了。|中午不要给阳台的植物浇水。|委员会三月份拒绝了这个方案，后来又通过了。|夜班火车星期一不开。|机器在日志里写下“我无法帮助您”，职员把它记了下来。""",
    "ja": """保証はできませんが、年に二回油をさすとドアは静かになります。|昼間は植物に水をやらないでください。|夜行列車は月曜日には走りません。|委員会は三月に計画を見直しました。""",
    "th": """รับประกันไม่ได้ แต่หยอดน้ำมันปีละสองครั้งประตูจะเงียบ|อย่ารดน้ำต้นไม้ตอนเที่ยง|รถไฟกลางคืนไม่วิ่งวันจันทร์|คณะกรรมการทบทวนแผนในเดือนมีนาคม""",
    "hi": """मैं पक्का नहीं कह सकता, लेकिन साल में दो बार तेल डालने से दरवाज़ा शांत रहता है।|दोपहर में पौधों को पानी न दें।|रात की ट्रेन सोमवार को नहीं चलती।|समिति ने मार्च में योजना बदल दी।""",
}
